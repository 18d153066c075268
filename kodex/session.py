"""Session services: the shared folder, staged tables, size-checked broadcasts and salted joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key that holds more than this share of the rows is hot. At most 1 / HOT_SHARE keys can be, which bounds their broadcast.
HOT_SHARE = 1 / 256
#: Parts into which a hot key is split.
SALTS = 32
#: Rows, and bytes in memory, up to which a staged table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 48 << 20
#: Bytes of files up to which a skewed left side is joined without splitting its hot keys.
PLAIN_BYTES = 16 << 20


#: Bytes of files a core below which a table is dealt out by `widened`.
SPLIT_BYTES = 4 << 20

_shipped: set[str] = set()


def _temporary() -> str:
    """A local folder that goes with this process."""
    folder = tempfile.mkdtemp(prefix="kodex-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(_temporary()) / "kodex.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset and the master is local, a local one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _local:
            _local[app] = "file://" + _temporary()
        folder = _local[app]
    return folder.rstrip("/")


def staged_dir(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    return f"{shared_dir(spark)}/kodex-{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: cuts lineage, survives lost executors.

    The tables of an application are in one folder, which `release` removes once its results have been read.
    """
    spark = df.sparkSession
    path = f"{staged_dir(spark)}/stage-{uuid.uuid4().hex}"
    # rows and bytes are summed as they are written, which spares is_small a job
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_size = (seen.get["n"], seen.get["bytes"])
    return out


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def release(spark: SparkSession) -> None:
    """Remove all tables that this application staged. Results that still read from them must have been written before."""
    files, path = hadoop_path(spark, staged_dir(spark))
    files.delete(path, True)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes in memory."""
    def width(name: str, kind: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 24
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 24
        return F.lit(8)

    return reduce(lambda a, b: a + b, [width(f.name, f.dataType).cast("long") for f in df.schema.fields], F.lit(40).cast("long"))


def file_bytes(df: DataFrame) -> int:
    """Catalyst's size of a plan: for a table that is only read, that of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(staged: DataFrame, rows: int | None = None) -> bool:
    """Whether a staged table has at most `rows` rows and BROADCAST_BYTES in memory, as summed when it was written.

    Of a table made of a staged one the files are asked first, then the rows themselves.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    if rows < 0:
        return False
    if hasattr(staged, "_staged_size"):
        n, size = staged._staged_size
    elif file_bytes(staged) > BROADCAST_BYTES:
        return False
    else:
        n, size = staged.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(row_bytes(staged)), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


def sized_broadcast(staged: DataFrame, rows: int | None = None) -> DataFrame:
    """A staged table with a broadcast hint if it is small; else unhinted, so that the join shuffles."""
    return F.broadcast(staged) if is_small(staged, rows) else staged


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Distinct keys that hold more than `share` of df's rows: at most 1 / share rows by construction."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.filter(F.col("_n") > total.scalar() * F.lit(share)).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Equi-join that splits the hot keys of `left` into `salts` parts and repeats the right rows of just those keys.

    `how`: inner, left, left_semi or left_anti. Rows with a null key match nothing. A left side of at most PLAIN_BYTES of files
    can't overload a task and is joined as it is. `hot` may be given when it is known or
    can be counted on something cheaper than `left`, which is else computed once more for it; it is broadcast, being
    bounded by 1 / HOT_SHARE rows.
    """
    if file_bytes(left) <= PLAIN_BYTES:
        return left.join(right, keys, how)
    hot = F.broadcast((hot_keys(left, keys) if hot is None else hot).withColumn("_hot", F.lit(True)))
    # the salt is a function of the row, so a recomputed task gives the same part
    parts = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return parts.join(copies, [*keys, "_salt"], how).drop("_salt")


def lookup(left: DataFrame, staged: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Join a skewed left side with a staged table: by broadcast if that is small, else salted.

    Hot keys are counted on `counted`, where that is cheaper than `left`.
    """
    if is_small(staged, rows):
        return left.join(F.broadcast(staged), keys, how)
    return salted_join(left, staged, keys, how, hot_keys(left if counted is None else counted, keys))


def enriched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", counted: DataFrame | None = None) -> DataFrame:
    """lookup in a table that isn't staged yet, which it is only where the left side is too large for a plain join.

    `counted` stands for the left side, as to its size and its hot keys.
    """
    if file_bytes(left if counted is None else counted) <= PLAIN_BYTES:
        return left.join(right, keys, how)
    return lookup(left, stage(right), keys, how, counted=counted)


def widened(rows: DataFrame) -> DataFrame:
    """A table's rows dealt out over all cores where its files are too few to fill them by their own splits.

    Decided by the files' size: a table of more than SPLIT_BYTES a core is never shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if file_bytes(rows) > SPLIT_BYTES * cores:
        return rows
    return rows.repartition(cores, F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by unique keys over as many tasks as shuffles have, for costly work after a join on skewed ones."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def day_string(day: Column) -> Column:
    """yyyy-MM-dd; null is the open end 9999-12-31."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("9999-12-31"))
