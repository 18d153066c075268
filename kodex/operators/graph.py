"""The citation graph: edges, labels, authority, versions of provisions in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodex.operators.asof import winners
from kodex.operators.sweep import coverage
from kodex.session import enriched, hot_keys, salted_join, stage


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest in `order`, whose last column should be unique. Combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def latest_treatments(treatments: DataFrame) -> DataFrame:
    """One treatment per citation: the newest, of equals the greatest id. An unknown label is UNCLASSIFIED."""
    from kodex.schema import LABELS

    return latest(treatments, ["citation_id"], ["created_at", "id"]).withColumn("label", F.when(F.col("label").isin(LABELS), F.col("label")).otherwise("UNCLASSIFIED"))


def treatments_for(citations: DataFrame, treatments: DataFrame, decisions: DataFrame, authority: DataFrame) -> DataFrame:
    """Labelled edges between two known, different decisions, with the citing side's authority over the cited court.

    citations: id, citing_ecli, cited_ecli, paragraph_idx; decisions: ecli, court_code, panel_type, decided_on. The
    authority table has a row per pair of courts and panel and is broadcast; a missing row doesn't bind. Decisions that are
    cited by a large part of all edges are salted.
    """
    edges = citations.filter("cited_ecli is not null and citing_ecli <> cited_ecli").select(F.col("id").alias("citation_id"), "citing_ecli", "cited_ecli", "paragraph_idx")
    labelled = edges.join(latest_treatments(treatments).select("citation_id", "label", "confidence", "evidence_span"), "citation_id")
    cited = decisions.select(F.col("ecli").alias("cited_ecli"), F.col("court_code").alias("cited_court"))
    citing = decisions.select(F.col("ecli").alias("citing_ecli"), F.col("court_code").alias("citing_court"), F.col("panel_type").alias("citing_panel"), F.col("decided_on").alias("citing_date"))
    # hot decisions are counted over the edges alone
    rows = salted_join(labelled, cited, ["cited_ecli"], hot=hot_keys(edges, ["cited_ecli"]))
    rows = salted_join(rows, citing, ["citing_ecli"], hot=hot_keys(edges, ["citing_ecli"]))
    rows = rows.join(F.broadcast(authority.select("citing_court", "citing_panel", "cited_court", "binding")), ["citing_court", "citing_panel", "cited_court"], "left")
    return rows.withColumn("may_depart", F.coalesce("binding", F.lit(False))).drop("binding")


def followed(citations: DataFrame, treatments: DataFrame) -> DataFrame:
    """Distinct (citing_ecli, cited_ecli) whose latest label is FOLLOWED; any confidence, any date."""
    edges = citations.filter("cited_ecli is not null and citing_ecli <> cited_ecli").select(F.col("id").alias("citation_id"), "citing_ecli", "cited_ecli")
    ok = latest_treatments(treatments).filter("label = 'FOLLOWED'").select("citation_id")
    return edges.join(ok, "citation_id").select("citing_ecli", "cited_ecli").distinct()


def in_force(rows: DataFrame, versions: DataFrame, day: str, prefix: str) -> DataFrame:
    """rows (with provision_id and a day column) with <prefix>_id, <prefix>_from of the version in force, null if none.

    Of several versions in force the one that starts last counts, of equals the greatest id. Each provision and day is
    looked up once, through the disjoint intervals between changes of asof.winners; rows of a hot provision are salted.
    """
    days = rows.select("provision_id", F.col(day).alias("day")).distinct()
    best = winners(versions, days, "provision_id", "valid_from", "valid_to", None, "id")
    starts = versions.select("id", F.col("valid_from").alias(f"{prefix}_from"))
    found = best.join(starts, "id").select("provision_id", F.col("day").alias(day), F.col("id").alias(f"{prefix}_id"), f"{prefix}_from")
    return enriched(rows, found, ["provision_id", day]).select(*rows.columns, f"{prefix}_id", f"{prefix}_from")


def differing_pairs(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """The distinct (v0_id, v1_id) of pairs whose bodies differ; a pair that many decisions share is compared once."""
    bodies = lambda side: versions.select(F.col("id").alias(f"{side}_id"), F.col("body").alias(f"_{side}"))
    asked = pairs.filter("v0_id <> v1_id").select("v0_id", "v1_id").distinct()
    return asked.join(bodies("v0"), "v0_id").join(bodies("v1"), "v1_id").filter("_v0 <> _v1").select("v0_id", "v1_id")


def in_force_at(versions: DataFrame, day: Column) -> DataFrame:
    """(provision_id, id, body, from) in force on one day: the versions are filtered first, then the best per provision taken."""
    hit = versions.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
    return hit.groupBy("provision_id").agg(F.max_by(F.struct("id", "body", F.col("valid_from").alias("from")), F.struct("valid_from", "id")).alias("v")).select("provision_id", "v.*")


def latest_materiality(judgements: DataFrame) -> DataFrame:
    """(v0_id, v1_id, material): the newest judgement of a pair, over all prompt versions; of equals the greatest prompt version."""
    return judgements.groupBy(F.col("from_version_id").alias("v0_id"), F.col("to_version_id").alias("v1_id")).agg(F.max_by("material", F.struct("created_at", "prompt_version")).alias("material"))


def derogations(versions: DataFrame, decisions: DataFrame, day: Column) -> DataFrame:
    """(provision_id, derogated_by, derogated_on): the last derogation that was decided by the day; of equals the greatest ecli."""
    cases = decisions.filter(F.col("decided_on") <= day).select(F.col("ecli").alias("derogated_by"), F.col("decided_on").alias("derogated_on"))
    hit = versions.filter("derogated_by is not null").select("provision_id", "derogated_by").distinct().join(cases, "derogated_by")
    return hit.groupBy("provision_id").agg(F.max(F.struct("derogated_on", "derogated_by")).alias("d")).select("provision_id", "d.derogated_by", "d.derogated_on")


def relied_on(citations: DataFrame, decisions: DataFrame, versions: DataFrame, judgements: DataFrame, day: Column) -> DataFrame:
    """One row per decision and provision it cites: reworded, changed_on, material, derogated_by.

    reworded: both a version on the decision's day and one on `day`, with different bodies. changed_on: the start of the
    latter where it is another version or the former is missing. material is false unless the pair was judged so.
    """
    cases = decisions.select(F.col("ecli").alias("citing_ecli"), "decided_on")
    cited = citations.filter("cited_provision is not null").select("citing_ecli", F.col("cited_provision").alias("provision_id")).distinct()
    dated = stage(salted_join(cited, cases, ["citing_ecli"]))
    now = in_force_at(versions, day).select("provision_id", F.col("id").alias("v1_id"), F.col("from").alias("v1_from"))
    rows = enriched(in_force(dated, versions, "decided_on", "v0"), now, ["provision_id"], counted=dated)
    rows = stage(enriched(rows, derogations(versions, decisions, day), ["provision_id"], counted=dated))
    reworded = differing_pairs(rows, versions).withColumn("reworded", F.lit(True))
    pairs = rows.select("v0_id", "v1_id").distinct().join(reworded, ["v0_id", "v1_id"], "left").join(latest_materiality(judgements), ["v0_id", "v1_id"], "left")
    rows = enriched(rows, pairs, ["v0_id", "v1_id"])
    return rows.select(
        F.col("citing_ecli").alias("ecli"),
        "provision_id",
        F.coalesce("reworded", F.lit(False)).alias("reworded"),
        F.when(~F.col("v0_id").eqNullSafe(F.col("v1_id")), F.col("v1_from")).alias("changed_on"),
        F.coalesce("material", F.lit(False)).alias("material"),
        "derogated_by",
    )


def pending_rewordings(citations: DataFrame, decisions: DataFrame, versions: DataFrame, judgements: DataFrame, day: Column, prompt_version: str) -> DataFrame:
    """Distinct (from_version_id, to_version_id) of reworded provisions that this prompt version hasn't judged."""
    cases = decisions.select(F.col("ecli").alias("citing_ecli"), "decided_on")
    # many decisions share a provision and a day: the pair is looked up once
    cited = citations.filter("cited_provision is not null").select("citing_ecli", F.col("cited_provision").alias("provision_id")).distinct()
    asked = stage(salted_join(cited, cases, ["citing_ecli"]).select("provision_id", "decided_on").distinct())
    now = in_force_at(versions, day).select("provision_id", F.col("id").alias("v1_id"))
    rows = stage(enriched(in_force(asked, versions, "decided_on", "v0"), now, ["provision_id"], "inner", counted=asked))
    pairs = differing_pairs(rows, versions).select(F.col("v0_id").alias("from_version_id"), F.col("v1_id").alias("to_version_id"))
    done = judgements.filter(F.col("prompt_version") == prompt_version).select("from_version_id", "to_version_id")
    return pairs.join(done, ["from_version_id", "to_version_id"], "left_anti")


#: Days in the buckets by which overlapping windows find each other.
OVERLAP_BUCKET = 3653


def overlaps(versions: DataFrame, bucket: int = OVERLAP_BUCKET) -> DataFrame:
    """(provision_id, earlier_id, later_id) of windows of a provision where the later starts within the earlier.

    The later window is looked for only in the time buckets that the earlier one covers, so that a provision with many
    windows is spread over as many tasks as it has buckets.
    """
    last = F.lit(4_000_000)
    v = versions.filter("valid_from is not null").select("provision_id", "id", F.unix_date("valid_from").alias("f"), F.coalesce(F.unix_date("valid_to"), last).alias("t"))
    high = v.agg(F.max("f").alias("_high"))
    a = v.join(F.broadcast(high)).withColumn("_b", F.explode(F.sequence(F.floor(F.col("f") / bucket), F.floor(F.greatest(F.col("f"), F.least("t", "_high")) / bucket))))
    a = a.select("provision_id", "_b", F.col("id").alias("earlier_id"), F.col("f").alias("_f"), F.col("t").alias("_t"))
    b = v.select("provision_id", F.floor(F.col("f") / bucket).alias("_b"), F.col("id").alias("later_id"), F.col("f").alias("_start"))
    return a.join(b, ["provision_id", "_b"]).filter("_start > _f and _t >= _start").select("provision_id", "earlier_id", "later_id")


def overlap_counts(versions: DataFrame) -> DataFrame:
    """(provision_id, day, n_starting, n_earlier): per start day how many windows start and how many earlier ones reach it.

    Earlier ones that reach a day are those that started before it less those that ended before it, so starts and ends are
    summed per day and their running sums compared: a provision's group is bounded by the calendar, and no pair is made.
    """
    rows = versions.filter("valid_from is not null").select("provision_id", F.unix_date("valid_from").alias("_f"), F.unix_date("valid_to").alias("_t"))
    # a window that ends before it starts reaches no day, but is reached
    whole = F.col("_t").isNull() | (F.col("_t") >= F.col("_f"))
    entry = lambda day, starting, d: F.struct(day.alias("_day"), F.lit(starting).cast("long").alias("_s"), d.cast("long").alias("_d"))
    one, none = F.when(whole, 1).otherwise(0), F.lit(0)
    # a start counts from the day after it, an end likewise
    events = rows.select("provision_id", F.inline(F.array(entry(F.col("_f"), 1, none), entry(F.col("_f") + 1, 0, one), entry(F.col("_t") + 1, 0, -one)))).filter("_day is not null")
    per = events.groupBy("provision_id", "_day").agg(F.sum("_s").alias("n_starting"), F.sum("_d").alias("_d"))
    reach = F.sum("_d").over(Window.partitionBy("provision_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("n_earlier", reach).filter("n_starting > 0").select("provision_id", F.date_from_unix_date("_day").alias("day"), "n_starting", "n_earlier")


def overlap_classes(versions: DataFrame) -> DataFrame:
    """(id, provision_id, class_from, links): every window with the first day of its continuous period and its number of earlier windows that reach its start.

    The windows of one period are one class of the overlaps; links are counted, never paired. An inverted window has no
    period of its own: its class is that of the period that covers its start, null if none does.
    """
    periods = coverage(versions, "provision_id", "valid_from", "valid_to").filter("kind = 'period'").select("provision_id", F.unix_date(F.col("day_from").cast("date")).alias("_c"))
    # the period of a start is the last that begins by it, if it reaches it: both are events on one line of days
    starts = overlap_counts(versions)
    marks = periods.select("provision_id", "_c", F.col("_c").alias("_day"), F.lit(0).alias("_k")).unionByName(starts.select("provision_id", F.lit(None).cast("int").alias("_c"), F.unix_date("day").alias("_day"), F.lit(1).alias("_k")))
    over = Window.partitionBy("provision_id").orderBy("_day", "_k").rowsBetween(Window.unboundedPreceding, 0)
    classes = marks.withColumn("_c", F.last("_c", ignorenulls=True).over(over)).filter("_k = 1").select("provision_id", F.date_from_unix_date("_day").alias("day"), F.date_from_unix_date("_c").alias("_c"))
    days = starts.join(classes, ["provision_id", "day"]).select("provision_id", F.col("day").alias("valid_from"), "_c", "n_earlier")
    rows = enriched(versions.filter("valid_from is not null").select("id", "provision_id", "valid_from", "valid_to"), days, ["provision_id", "valid_from"], "inner")
    inverted = F.coalesce(F.col("valid_to") < F.col("valid_from"), F.lit(False))
    return rows.select("id", "provision_id", F.when(~inverted | (F.col("n_earlier") > 0) | (F.col("_c") == F.col("valid_from")), F.col("_c")).alias("class_from"), F.col("n_earlier").alias("links"))


def timeline_problems(versions: DataFrame) -> DataFrame:
    """(provision_id, problem, n): overlapping pairs, which are counted without being made, and more than one open window."""
    pairs = overlap_counts(versions).groupBy("provision_id").agg(F.sum(F.col("n_starting") * F.col("n_earlier")).alias("n")).filter("n > 0").select("provision_id", F.lit("overlap").alias("problem"), "n")
    open_ = versions.filter("valid_to is null").groupBy("provision_id").agg(F.count("*").alias("n")).filter("n > 1").select("provision_id", F.lit("open").alias("problem"), "n")
    return pairs.unionByName(open_)


def judged_versions(versions: DataFrame, judgements: DataFrame) -> DataFrame:
    """Versions that some judgement names on either side: the disjunctive join as one semi join on exploded ids."""
    named = judgements.select(F.explode(F.array("from_version_id", "to_version_id")).alias("id")).distinct()
    return versions.join(named, "id", "left_semi")


#: Paragraphs of a decision that one task handles at a time.
CUT = 512


def context_windows(paragraphs: DataFrame, radius: int = 2) -> DataFrame:
    """(ecli, idx, context, focus): each paragraph with `radius` real ones on either side, whatever gaps idx has.

    Paragraphs are numbered within their decision over cuts that are counted first; each run of CUT numbers then gets the
    `radius` paragraphs before and after it as well, so that a decision with a large part of all rows is no single task and
    hardly any text is sent twice.
    """
    rows = paragraphs.select("ecli", "idx", "body", F.floor(F.col("idx") / CUT).alias("_c"))
    sizes = rows.groupBy("ecli", "_c").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("ecli").orderBy("_c")) - F.col("_n")).drop("_n")
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("ecli", "_c").orderBy("idx")) - 1).join(before, ["ecli", "_c"]).withColumn("_i", F.col("_i") + F.col("_before"))
    numbered = numbered.withColumn("_own", F.floor(F.col("_i") / CUT)).withColumn("_in", F.col("_i") % CUT)
    runs = F.array(F.col("_own"), F.when(F.col("_in") < radius, F.col("_own") - 1), F.when(F.col("_in") >= CUT - radius, F.col("_own") + 1))
    sent = numbered.select("ecli", "idx", "body", "_i", "_own", F.explode(F.array_compact(runs)).alias("_run"))
    order = Window.partitionBy("ecli", "_run").orderBy("_i")
    near = sent.withColumn("context", F.collect_list("body").over(order.rowsBetween(-radius, radius))).withColumn("focus", F.least(F.row_number().over(order) - 1, F.lit(radius)))
    return near.filter("_run = _own").select("ecli", "idx", "context", "focus")
