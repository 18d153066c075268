"""What is known against a decision as of a day, and the light that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodex.session import salted_join, stage, union_all

# The confidence from which a label counts.
RED_BAR, AMBER_BAR = "0.85", "0.60"
#: Fields of a reason; those that a kind of reason doesn't have are null.
FIELDS = "row_ord int, kind string, by_ecli string, panel string, span string, provision_id long, changed_on date, citation_id long, via_ecli string"


def _reasons(rows: DataFrame, row_ord: int, kind: str, k1: Column, k2: Column, **fields: str) -> DataFrame:
    """Reason rows; k1 and k2 order the reasons within one row of the table."""
    names = dict(x.split() for x in FIELDS.split(", "))
    values = {"row_ord": F.lit(row_ord), "kind": F.lit(kind)} | {n: F.col(c) for n, c in fields.items()}
    return rows.select("ecli", k1.cast("string").alias("_k1"), k2.cast("string").alias("_k2"), *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def reasons(treatments: DataFrame, provisions: DataFrame, inherited: DataFrame, day: Column) -> DataFrame:
    """Distinct reason rows (ecli, ord, fields of FIELDS) in their order; ord 1, 2 and 3 are red, the others amber.

    treatments is treatments_for's result, provisions relied_on's, inherited is (ecli, via_ecli) of red sources. What became
    known after the day isn't evidence. A departure with authority below the red bar counts for nothing.
    """
    t = treatments.filter(F.col("citing_date") <= day).withColumn("ecli", F.col("cited_ecli"))
    p = provisions.filter(F.col("changed_on").isNull() | (F.col("changed_on") <= day))
    bar = lambda b: F.col("confidence") >= F.lit(b).cast("decimal(3,2)")
    by_date, pid = (F.col("citing_date"), F.col("citing_ecli")), (F.lpad(F.col("provision_id").cast("string"), 20, "0"), F.lit(""))
    said = {"by_ecli": "citing_ecli", "span": "evidence_span"}
    every = union_all([
        _reasons(t.filter((F.col("label") == "QUASHED") & bar(RED_BAR)), 1, "Quashed", *by_date, **said),
        _reasons(t.filter((F.col("label") == "DEPARTED") & F.col("may_depart") & bar(RED_BAR)), 2, "Superseded", *by_date, panel="citing_panel", **said),
        _reasons(p.filter("derogated_by is not null"), 3, "ProvisionDerogated", *pid, provision_id="provision_id", by_ecli="derogated_by"),
        _reasons(t.filter((F.col("label") == "DEPARTED") & ~F.col("may_depart") & bar(AMBER_BAR)), 4, "Conflict", *by_date, **said),
        _reasons(t.filter((F.col("label") == "NARROWED") & bar(AMBER_BAR)), 5, "Narrowed", *by_date, **said),
        _reasons(p.filter("reworded and material and changed_on is not null"), 6, "ProvisionReworded", *pid, provision_id="provision_id", changed_on="changed_on"),
        _reasons(t.filter("label = 'UNCLASSIFIED'"), 7, "NeedsReview", *by_date, by_ecli="citing_ecli", citation_id="citation_id"),
        _reasons(inherited, 8, "InheritedWeakness", F.col("via_ecli"), F.lit(""), via_ecli="via_ecli"),
    ])
    fields = [x.split()[0] for x in FIELDS.split(", ")]
    return every.groupBy("ecli", *fields).agg(F.min(F.struct("_k1", "_k2")).alias("_k"))


def lights(keys: DataFrame, found: DataFrame) -> DataFrame:
    """(ecli, light, n_reasons) for each of keys: RED with a reason of rows 1 to 3, AMBER with another, else GREEN."""
    worst = found.groupBy("ecli").agg(F.min("row_ord").alias("_worst"), F.count("*").alias("n_reasons"))
    rows = keys.select("ecli").join(worst, "ecli", "left")
    return rows.select("ecli", F.when(F.col("_worst") <= 3, "RED").when(F.col("_worst").isNotNull(), "AMBER").otherwise("GREEN").alias("light"), F.coalesce("n_reasons", F.lit(0)).alias("n_reasons"))


def standing(requested: DataFrame, treatments: DataFrame, provisions: DataFrame, follows: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """(lights, reasons) of the requested decisions, weakness handed on over exactly one hop.

    First every decision's own evidence gives its light; then a decision gets an amber reason for each decision it follows
    whose own light is red. No third decision can matter, whatever cycles the graph has.
    """
    none = follows.limit(0).select(F.col("citing_ecli").alias("ecli"), F.col("cited_ecli").alias("via_ecli"))
    own = stage(reasons(treatments, provisions, none, day))
    red = own.filter("row_ord <= 3").select(F.col("ecli").alias("via_ecli")).distinct()
    weak = salted_join(follows.select(F.col("citing_ecli").alias("ecli"), F.col("cited_ecli").alias("via_ecli")), red, ["via_ecli"], "left_semi")
    handed = reasons(treatments.limit(0), provisions.limit(0), weak, day)
    every = own.unionByName(handed).join(requested.select("ecli").distinct(), "ecli", "left_semi")
    return lights(requested, every), every


def ordered(found: DataFrame) -> DataFrame:
    """(ecli, reasons array): each decision's reasons in order, as structs of FIELDS."""
    fields = [x.split()[0] for x in FIELDS.split(", ")]
    entry = F.struct("row_ord", "_k", F.struct(*fields).alias("r"))
    return found.groupBy("ecli").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["r"]).alias("reasons"))


def corpus_scope(meta: DataFrame, day: Column) -> DataFrame:
    """One row (corpus_size, corpus_through): all decisions, and the day through which every court is covered, or `day` if there are none."""
    return meta.agg(F.coalesce(F.sum("decision_count"), F.lit(0)).alias("corpus_size"), F.coalesce(F.min("covered_through"), day).alias("corpus_through"))
