"""Scores of predicted labels and spans against gold ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kodex.schema import CLUSTER, LABELS

NONE = "(none)"


def ratio(a: Column, b: Column) -> Column:
    """Rounded to 6 places; null where b is 0."""
    return F.round(F.try_divide(a, b), 6)


def match_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """gold (citing_ecli, cited_ecli, paragraph_idx, gold_label) with predicted: the exact triple's, else the pair's if it has just one, else (none).

    predictions: citing_ecli, cited_ecli, paragraph_idx, label, created_at, id; the newest of a triple counts.
    """
    pair = ["citing_ecli", "cited_ecli"]
    newest = predictions.groupBy(*pair, "paragraph_idx").agg(F.max_by("label", F.struct("created_at", "id")).alias("label"))
    exact = newest.withColumn("_p", F.coalesce("paragraph_idx", F.lit(-1))).select(*pair, "_p", F.col("label").alias("_exact"))
    only = newest.groupBy(*pair).agg(F.count("*").alias("_n"), F.first("label").alias("_pair")).filter("_n = 1").drop("_n")
    rows = gold.withColumn("_p", F.coalesce("paragraph_idx", F.lit(-1))).join(exact, [*pair, "_p"], "left").join(only, pair, "left")
    return rows.select(*gold.columns, F.coalesce("_exact", "_pair", F.lit(NONE)).alias("predicted"), F.col("_exact").isNotNull().alias("exact_paragraph"))


def label_scores(scored: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of every label that occurs in gold or predictions."""
    one = F.lit(1).cast("long")
    hits = F.array(F.struct(F.col("gold_label").alias("label"), (F.col("gold_label") == F.col("predicted")).alias("hit"), F.lit(True).alias("gold")), F.struct(F.col("predicted").alias("label"), (F.col("gold_label") == F.col("predicted")).alias("hit"), F.lit(False).alias("gold")))
    rows = scored.select(F.inline(hits)).filter(F.col("label").isin(LABELS))
    total = lambda c: F.coalesce(F.sum(F.when(c, one)), F.lit(0))
    sums = rows.groupBy("label").agg(total(F.col("gold") & F.col("hit")).alias("tp"), total(~F.col("gold") & ~F.col("hit")).alias("fp"), total(F.col("gold") & ~F.col("hit")).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(F.try_divide(2 * p * r, p + r), 6))


def confusion(scored: DataFrame) -> DataFrame:
    """gold_label and a count column for each label and for (none), which is named none."""
    columns = [*LABELS, NONE]
    return scored.groupBy("gold_label").pivot("predicted", columns).count().fillna(0).withColumnRenamed(NONE, "none")


def cluster_scores(scored: DataFrame) -> DataFrame:
    """One row: gold rows of the labels hard to tell apart, and where they went."""
    g, p = F.col("gold_label").isin(CLUSTER), F.col("predicted").isin(CLUSTER)
    same = F.col("gold_label") == F.col("predicted")
    n = lambda c: F.count_if(c)
    sums = scored.agg(n(g).alias("gold_rows"), n(g & same).alias("exact"), n(g & p & ~same).alias("inside"), n(g & ~p).alias("leaked_out"), n(~g & p).alias("leaked_in"))
    return sums.withColumn("accuracy", ratio(F.col("exact"), F.col("gold_rows")))


def red_scores(scored: DataFrame) -> DataFrame:
    """One row tp, fp, fn, precision, recall of RED: QUASHED, or DEPARTED with may_depart."""
    red = lambda c: (F.col(c) == "QUASHED") | ((F.col(c) == "DEPARTED") & F.col("may_depart"))
    g, p = red("gold_label"), red("predicted")
    sums = scored.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def span_scores(gold: DataFrame, found: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """(kind, tp, fp, fn, precision, recall) by equality of whole spans, repeated ones counting once.

    Where both sides have `groups` (map), also group_mismatches: spans that both have, with other groups.
    """
    grouped = "groups" in gold.columns and "groups" in found.columns
    # a map isn't orderable, its sorted text is
    said = F.to_json(F.array_sort(F.map_entries("groups"))) if grouped else F.lit("")
    side = lambda df, name: df.groupBy(*keys, kind).agg(F.max(F.coalesce(said, F.lit("[]"))).alias(name))
    rows = side(gold, "_g").join(side(found, "_f"), [*keys, kind], "full")
    both, only_f, only_g = F.col("_g").isNotNull() & F.col("_f").isNotNull(), F.col("_g").isNull(), F.col("_f").isNull()
    more = [F.count_if(both & (F.col("_g") != F.col("_f"))).alias("group_mismatches")] if grouped else []
    sums = rows.groupBy(kind).agg(F.count_if(both).alias("tp"), F.count_if(only_f).alias("fp"), F.count_if(only_g).alias("fn"), *more)
    return sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
