"""The batch operators over streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kodex.operators.graph import latest
from kodex.session import hadoop_path, shared_dir

#: Hash buckets of a kept table; a batch rewrites only those it touches.
BUCKETS = 64


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = 64) -> DataFrame:
    """A table of the data folder as a file stream; all files in one batch if no number is given."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(f"{path}*")


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) per tumbling window, closed once the watermark passes; later events are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


class KeptLatest:
    """A table that holds each key's latest row, folded batch by batch, in hash buckets of which a batch rewrites those it touches.

    A batch writes its buckets beside the old ones and then commits: a manifest, renamed into place, that names the folder of
    every bucket. A new instance on the same folder goes on from the last manifest. A batch that fell before its commit is
    folded again, one that was committed is not, so neither a restart nor a repeated batch loses or changes rows. Buckets that
    neither of the last two manifests names are removed. `buckets` is fixed when the table is begun; one bucket is one task.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.keys, self.order = spark, keys, order
        self.folder = folder or f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
        self.files, _ = hadoop_path(spark, self.folder)
        self.state = self._manifests(1)[-1:] or [{"number": -1, "query": "", "schema": "", "buckets": buckets, "at": {}}]
        self.state = self.state[0]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _text(self, name: str) -> str:
        if not self.files.exists(self._path(name)):
            return ""
        stream = self.files.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifests(self, last: int) -> list[dict]:
        """The last manifests, the newest at the end; they are numbered as they are committed."""
        if not self.files.exists(self._path("manifests")):
            return []
        names = sorted(s.getPath().getName() for s in self.files.listStatus(self._path("manifests")) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._text(f"manifests/{n}")) | {"name": n} for n in names[-last:]]

    def _commit(self, state: dict) -> None:
        name = f"{int(self.state.get('name', '0').split('.')[0]) + 1:020d}.json"
        out = self.files.create(self._path(f"manifests/{name}.new"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.files.rename(self._path(f"manifests/{name}.new"), self._path(f"manifests/{name}")):
            raise RuntimeError(f"another writer has committed {name}")
        self.state = state | {"name": name}
        kept = self._manifests(2)
        named = {f"{folder}/_bucket={b}" for m in kept for b, folder in m["at"].items()}
        for folder in self.files.listStatus(self._path("rows")) if self.files.exists(self._path("rows")) else []:
            for bucket in self.files.listStatus(folder.getPath()):
                where = f"{folder.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and where not in named:
                    self.files.delete(bucket.getPath(), True)

    def _read(self, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.state["schema"]))
        paths = [f"{self.folder}/rows/{self.state['at'][b]}/_bucket={b}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def fold(self, batch: DataFrame, number: int) -> None:
        """Fold a batch in; one of the same stream with this or a later number that was committed changes nothing."""
        query = self._text("checkpoint/metadata")
        if query == self.state["query"] and number <= self.state["number"]:
            return
        count = self.state["buckets"]
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int"))
        # at most `buckets` numbers
        touched = sorted(str(r[0]) for r in rows.select("_bucket").distinct().collect())
        state = {"number": number, "query": query, "schema": batch.schema.json(), "buckets": count, "at": dict(self.state["at"])}
        if touched:
            old = [b for b in touched if b in state["at"]]
            every = self._read(old).select(*batch.columns).unionByName(batch) if old else batch
            folder = f"{number}-{uuid.uuid4().hex}"
            best = latest(every, self.keys, self.order).select(*batch.columns).withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int"))
            best.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/rows/{folder}")
            state["at"] |= dict.fromkeys(touched, folder)
        self._commit(state)

    def table(self, schema: StructType | None = None) -> DataFrame:
        """The table as last committed."""
        return self._read(sorted(self.state["at"])) if self.state["schema"] else self.spark.createDataFrame([], schema)

    def run(self, stream: DataFrame) -> DataFrame:
        """Fold all that the stream has now and give the table."""
        q = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.table(stream.schema)


def drained(stream: DataFrame) -> DataFrame:
    """All that an append stream gives now, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
