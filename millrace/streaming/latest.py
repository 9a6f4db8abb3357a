"""A log as a stream of commits, and the latest value per key kept up with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.maintain import compact
from millrace.operators.view import resolve


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of (key, seq, kind, val) as Parquet, a directory per commit; a commit that runs again overwrites its own."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/commit={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start()


def latest(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """The view over what is committed, from the whole log: any snapshot."""
    return resolve(spark.read.parquet(path).drop("commit"), None, snapshot)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a compacted state, an entry per key: each micro-batch is compacted with the version before into the next.

    A commit's work grows with the state and the batch, not with the log. A commit that runs again reads the same
    version and overwrites its own; the version before the last goes.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = ["key", "seq", "kind", "val"]
        rows = batch.select(columns)
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}").select(columns))
        compact(rows, [], True).drop("stripe").write.mode("overwrite").parquet(f"{path}/version={number}")
        if number > 1:
            where, fs = _files(spark, f"{path}/version={number - 2}")
            fs.delete(where, True)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start()


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The latest value per key, of the newest whole version."""
    where, fs = _files(spark, f"{path}/version=*/_SUCCESS")
    found = [int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(where)]
    return resolve(spark.read.parquet(f"{path}/version={max(found)}"))


def replay(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """A captured workload: the commits first to last of a stored log, in order, each entry with its commit."""
    return spark.read.parquet(path).where(f"commit between {first} and {last}").orderBy("commit", "seq")
