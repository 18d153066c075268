"""Attributes valid and known on an event's day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodex.session import lookup, salted_join, stage

#: Days in a time bucket.
BUCKET_DAYS = 366


def winners(versions: DataFrame, days: DataFrame, entity: str, valid_from: str, valid_to: str, known_from: str | None, version_id: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """The version in force and known on each of `days` (entity, day): rows (entity, day, version_id), none where there is none.

    A version holds on day D if valid_from <= D <= valid_to (null: open) and known_from <= D; of several the one with the
    latest valid_from, then the latest known_from, then the greatest id. Versions without entity, valid_from or known_from
    and inverted ones hold on no day. `days` may repeat.

    Each version is cut into time buckets of `bucket_days`; equal stretches of a bucket are reduced to their best version
    before the shuffle, so that a bucket of one entity has at most bucket_days^2 / 2 of them however many rows the entity
    has. The successive change times of a bucket give disjoint half-open intervals with one best version each, and a day
    finds its interval by an equi-join on (entity, bucket) with half-open containment.
    """
    wanted = days.select(F.col(entity).alias("_e"), F.unix_date(F.col("day").cast("date")).alias("_d")).filter("_e is not null and _d is not null").distinct()
    wanted = wanted.withColumn("_b", F.floor(F.col("_d") / bucket_days))
    low, high = (F.coalesce(wanted.agg(f("_d")).scalar(), F.lit(0)) for f in (F.min, F.max))
    known = F.col(known_from) if known_from else F.col(valid_from)
    rows = versions.select(
        F.col(entity).alias("_e"),
        F.unix_date(F.greatest(valid_from, known)).alias("_s"),
        F.coalesce(F.unix_date(F.col(valid_to)) + 1, high + 1).alias("_t"),
        F.struct(F.col(valid_from).alias("f"), known.alias("k"), F.col(version_id).alias("v")).alias("_p"),
    ).filter("_e is not null and _p.f is not null and _p.k is not null")
    # only the stretch in which events lie is cut into buckets
    rows = rows.withColumn("_s", F.greatest("_s", low)).withColumn("_t", F.least("_t", high + 1)).filter("_s < _t")
    cut = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket_days), F.floor((F.col("_t") - 1) / bucket_days))))
    cut = cut.withColumn("_s", F.greatest("_s", F.col("_b") * bucket_days)).withColumn("_t", F.least("_t", (F.col("_b") + 1) * bucket_days))
    best = cut.groupBy("_e", "_b", "_s", "_t").agg(F.max("_p").alias("_p"))
    changes = best.select("_e", "_b", F.explode(F.array("_s", "_t")).alias("_c")).distinct()
    pieces = changes.withColumn("_n", F.lead("_c").over(Window.partitionBy("_e", "_b").orderBy("_c"))).filter("_n is not null")
    valid = pieces.join(best, ["_e", "_b"]).filter("_s <= _c and _t >= _n").groupBy("_e", "_b", "_c", "_n").agg(F.max("_p").alias("_p"))
    hits = wanted.join(valid, ["_e", "_b"]).filter("_c <= _d and _d < _n")
    return hits.select(F.col("_e").alias(entity), F.date_from_unix_date("_d").alias("day"), F.col("_p.v").alias(version_id))


def known_provisions(contexts: DataFrame, references: DataFrame, decisions: DataFrame, versions: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(request_id, provision_id, decided_version_id, asof_version_id) for each request and each provision its decision relies on.

    0 stands for no version, also where the decision or a day is missing. A decision fetched several times counts once,
    with its greatest decided_on. A decision cited or asked about often is salted. Empty tables give an empty result.
    """
    relied = references.filter("ecli is not null and resolved_provision_id is not null").select("ecli", F.col("resolved_provision_id").alias("provision_id")).distinct()
    decided = decisions.groupBy("ecli").agg(F.max("decided_on").alias("decided_on"))
    asked = contexts.filter("ecli is not null").select("request_id", "ecli", "as_of").distinct()
    relied = stage(relied)
    needed = lookup(relied, stage(asked.select("ecli").distinct().join(decided, "ecli", "left")), ["ecli"])
    pairs = stage(salted_join(asked, needed, ["ecli"]))
    # what a decision relies on is looked up for its own day once, not once for each request
    days = needed.select("provision_id", F.col("decided_on").alias("day")).unionByName(pairs.select("provision_id", F.col("as_of").alias("day")))
    found = stage(winners(versions, days, "provision_id", "valid_from", "valid_to", "recorded_on", "id", bucket_days))
    at_decision = found.select("provision_id", F.col("day").alias("decided_on"), F.col("id").alias("_v0"))
    at_asof = found.select("provision_id", F.col("day").alias("as_of"), F.col("id").alias("_v1"))
    # both lookups keep the rows of pairs, which is where their hot keys are counted
    out = lookup(pairs, at_decision, ["provision_id", "decided_on"], "left", counted=pairs)
    out = lookup(out, at_asof, ["provision_id", "as_of"], "left", counted=pairs)
    return out.select("request_id", "provision_id", F.coalesce("_v0", F.lit(0)).alias("decided_version_id"), F.coalesce("_v1", F.lit(0)).alias("asof_version_id"))
