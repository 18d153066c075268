"""Coverage of day intervals by a sweep line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodex.session import day_string


def coverage(intervals: DataFrame, entity: str, day_from: str, day_to: str) -> DataFrame:
    """Continuous periods and the gaps between them: (entity, kind, day_from, day_to), both ends inclusive.

    Boundaries become +1 and -1 events, which are summed per (entity, day) before they are shuffled; the prefix sum
    then runs over distinct days, so that an entity's group is bounded by the calendar however many intervals it has.
    A null day_to is open; a null day_from, or a day_to before day_from, covers nothing; a null entity is an entity of
    its own; repeated rows change nothing; an empty table gives an empty result. Extra columns are not looked at.
    """
    rows = intervals.select(F.col(entity).alias("_e"), F.col(day_from).cast("date").alias("_f"), F.col(day_to).cast("date").alias("_t"))
    rows = rows.filter(F.col("_f").isNotNull() & (F.col("_t").isNull() | (F.col("_t") >= F.col("_f"))))
    events = rows.select("_e", F.inline(F.array(
        F.struct(F.col("_f").alias("_day"), F.lit(1).alias("_d")),
        F.struct(F.date_add("_t", 1).alias("_day"), F.lit(-1).alias("_d")),
    ))).filter(F.col("_day").isNotNull())
    deltas = events.groupBy("_e", "_day").agg(F.sum("_d").alias("_d")).filter("_d <> 0")
    by_day = Window.partitionBy("_e").orderBy("_day")
    active = deltas.withColumn("_n", F.sum("_d").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    edges = active.withColumn("_before", F.col("_n") - F.col("_d")).filter("_n = 0 or _before = 0").withColumn("_next", F.lead("_day").over(by_day))
    return edges.filter("_n > 0 or _next is not null").select(
        F.col("_e").alias(entity),
        F.when(F.col("_n") > 0, "period").otherwise("gap").alias("kind"),
        day_string(F.col("_day")).alias("day_from"),
        day_string(F.date_sub("_next", 1)).alias("day_to"),
    )
