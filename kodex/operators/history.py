"""History of changing attributes from periodic snapshots, held as checkpoints and patches."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kodex.functions.text import squeeze
from kodex.session import day_string, hadoop_path, staged_dir

#: Every so many versions one is stored whole.
CHECKPOINT_EVERY = 8


def settle(dumps: DataFrame, keys: list[str], start: str, end: str, order: list[str], attributes: list[str]) -> DataFrame:
    """One record per (keys, start): the one greatest in `order`. Records with end before start or without start are void.

    The aggregate combines before the shuffle, and afterwards a key has at most one row per calendar day.
    """
    valid = dumps.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    best = F.max_by(F.struct(end, *attributes), F.struct(*order)).alias("_r")
    return valid.groupBy(*keys, start).agg(best).select(*keys, start, F.col(f"_r.{end}").alias(end), *[F.col(f"_r.{a}").alias(a) for a in attributes])


def to_patches(versions: DataFrame, keys: list[str], start: str, attributes: list[str], every: int = CHECKPOINT_EVERY, first: str | None = None) -> DataFrame:
    """Checkpoint-delta form: (keys, start, segment, is_full, patch_<a> struct or null per attribute).

    A patch holds an attribute only where it differs, null-safely, from the version before; every `every`-th version is full.
    `first` names a column with the segment that a key begins with, 0 by default.
    """
    w = Window.partitionBy(*keys).orderBy(start)
    rows = versions.withColumn("_k", F.row_number().over(w) - 1)
    rows = rows.withColumn("segment", (F.floor(F.col("_k") / every) + (F.col(first) if first else F.lit(0))).cast("int")).withColumn("is_full", F.col("_k") % every == 0)
    for a in attributes:
        changed = F.col("is_full") | ~F.col(a).eqNullSafe(F.lag(a).over(w))
        rows = rows.withColumn(f"patch_{a}", F.when(changed, F.struct(F.col(a).alias("v"))))
    return rows.select(*keys, start, "segment", "is_full", *[f"patch_{a}" for a in attributes])


def from_patches(patches: DataFrame, keys: list[str], start: str, attributes: list[str]) -> DataFrame:
    """The versions again: patches folded forward from the nearest checkpoint, segments apart from one another."""
    w = Window.partitionBy(*keys, "segment").orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    return patches.select(*keys, start, *[F.last(f"patch_{a}", ignorenulls=True).over(w)["v"].alias(a) for a in attributes])


class HistoryStore:
    """A stored history: checkpoints every so many versions and patches between them, in one folder, a generation per append.

    keys, start, end, attributes: as of `settle`; `order` decides between records of one key and start and is stored with
    them, so that a later dump may correct, repeat or fill in what earlier ones said. A generation is written beside the
    others and renamed when it is whole; readers take the last one. Null keys are a key of their own.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], start: str, end: str, order: list[str], attributes: list[str], every: int = CHECKPOINT_EVERY):
        self.spark, self.folder, self.keys, self.start, self.end, self.order, self.every = spark, folder, keys, start, end, order, every
        self.attributes = attributes
        self.stored = [end, *attributes, *order]
        self.files, self.path = hadoop_path(spark, folder)

    def _generations(self) -> list[str]:
        if not self.files.exists(self.path):
            return []
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.path) if s.getPath().getName().startswith("generation-"))

    def patches(self) -> DataFrame | None:
        """The last generation, None before the first."""
        found = self._generations()
        return self.spark.read.parquet(f"{self.folder}/{found[-1]}") if found else None

    def append(self, dump: DataFrame) -> None:
        """Take in the records of a dump. A key's segments before the first record that the dump gives for it stay as they are.

        The others are folded from that checkpoint on, settled with the new records and stored anew.
        """
        new = settle(dump, self.keys, self.start, self.end, self.order, [*self.attributes, *self.order]).select(*self.keys, self.start, *self.stored)
        old = self.patches()
        if old is None:
            whole = to_patches(new, self.keys, self.start, self.stored, self.every)
        else:
            touched = new.groupBy(*self.keys).agg(F.min(self.start).alias("_from"))
            # the segment of the nearest checkpoint by that day; an earlier record than all opens the first anew
            full = old.filter("is_full").select(*self.keys, F.col(self.start).alias("_at"), "segment")
            near = self._joined(touched, full, "left").groupBy(*self.keys).agg(F.coalesce(F.max(F.when(F.col("_at") <= F.col("_from"), F.col("segment"))), F.lit(0)).alias("_first"))
            marked = self._joined(old, near, "left")
            kept = marked.filter("_first is null or segment < _first").select(*old.columns)
            tail = from_patches(marked.filter("segment >= _first").select(*old.columns), self.keys, self.start, self.stored)
            again = settle(tail.select(*new.columns).unionByName(new), self.keys, self.start, self.end, self.order, [*self.attributes, *self.order])
            whole = kept.unionByName(to_patches(self._joined(again, near, "left"), self.keys, self.start, self.stored, self.every, "_first"))
        number, written = len(self._generations()), f"{self.folder}/writing-{uuid.uuid4().hex}"
        whole.write.option("compression", "zstd").parquet(written)
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not self.files.rename(jvm_path(written), jvm_path(f"{self.folder}/generation-{number:010d}")):
            raise RuntimeError("another writer has appended")

    def _joined(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Null-safe join on the keys, with left's."""
        r = right.select(*[F.col(k).alias(f"_r_{k}") for k in self.keys], *[c for c in right.columns if c not in self.keys])
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in self.keys])
        return left.join(r, on, how).drop(*[f"_r_{k}" for k in self.keys])

    def versions(self) -> DataFrame:
        """(keys, start, end, attributes) of every version, patches folded forward from the nearest checkpoint."""
        rows = self.patches()
        return from_patches(rows, self.keys, self.start, self.stored).select(*self.keys, self.start, self.end, *self.attributes)

    def latest_by(self, day: Column) -> DataFrame:
        """Of each key the last version that starts by the day: of its segments only the one of the nearest checkpoint is folded."""
        rows = self.patches().filter(F.col(self.start) <= day)
        near = rows.filter("is_full").groupBy(*self.keys).agg(F.max("segment").alias("_near"))
        rows = self._joined(rows, near, "inner").filter("segment = _near")
        found = from_patches(rows, self.keys, self.start, self.stored)
        rest = [self.start, self.end, *self.attributes]
        return found.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.start).alias("_v")).select(*self.keys, "_v.*")


def validity(versions: DataFrame, keys: list[str], start: str, end: str, same: list[Column]) -> DataFrame:
    """Close and merge versions: (keys, valid_from, valid_to) as day strings.

    A version ends on its declared end, but no later than the day before the next begins; the last may stay open.
    Neighbours equal in all of `same` (null-safe) are one row unless days lie between them.
    """
    w = Window.partitionBy(*keys).orderBy(start)
    rows = versions.select(*keys, F.col(start).alias("_f"), F.least(F.col(end), F.date_sub(F.lead(start).over(w), 1)).alias("_t"), *[s.alias(f"_s{i}") for i, s in enumerate(same)])
    w = Window.partitionBy(*keys).orderBy("_f")
    joined = F.date_add(F.lag("_t").over(w), 1) == F.col("_f")
    for i in range(len(same)):
        joined = joined & F.col(f"_s{i}").eqNullSafe(F.lag(f"_s{i}").over(w))
    rows = rows.withColumn("_run", F.sum(F.when(joined, 0).otherwise(1)).over(w))
    # the ends rise along a run and only the last can be open
    return rows.groupBy(*keys, "_run").agg(F.min("_f").alias("_f"), F.max_by("_t", "_f").alias("_t")).select(*keys, day_string(F.col("_f")).alias("valid_from"), day_string(F.col("_t")).alias("valid_to"))


def dump_store(dumps: DataFrame, every: int = CHECKPOINT_EVERY, folder: str | None = None) -> HistoryStore:
    """A store of provision_dump: all dumps but the last stored at once, the last one appended."""
    spark = dumps.sparkSession
    store = HistoryStore(spark, folder or f"{staged_dir(spark)}/history-{uuid.uuid4().hex}", ["act_no", "section", "_sub"], "valid_from", "valid_to", ["dump_on", "rec_id"], ["body", "derogated_by"], every)
    rows = dumps.select("act_no", "section", F.coalesce("subsec", F.lit("")).alias("_sub"), "valid_from", "valid_to", "body", "derogated_by", "dump_on", "rec_id")
    last = rows.agg(F.max("dump_on").alias("_last")).scalar()
    is_last = F.coalesce(F.col("dump_on") == last, F.lit(False))
    store.append(rows.filter(~is_last))
    store.append(rows.filter(is_last))
    return store


def provision_history(dumps: DataFrame, provisions: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """(provision_id, valid_from, valid_to) of every distinct wording in provision_dump, read from a store of its dumps.

    An empty subsec equals none; a dump record of no known provision gives nothing; a null body or derogated_by equals
    only null; ties in dump_on go to the greatest rec_id; a null dump_on is the earliest. Empty tables give an empty result.
    """
    ids = provisions.select(F.col("id").alias("provision_id"), "act_no", "section", F.coalesce("subsec", F.lit("")).alias("_sub"))
    versions = dump_store(dumps, every).versions().join(ids, ["act_no", "section", "_sub"])
    return validity(versions, ["provision_id"], "valid_from", "valid_to", [squeeze(F.col("body")), F.col("derogated_by")])
