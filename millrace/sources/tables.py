"""Sources: the driver's tables, an operation log derived from them, and Parquet stores sorted by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the first sequence number that a write may have.
FIRST_SEQ = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, kind, val (cents), day of every event."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "SET").when(F.col("event_type") == "error", "DEL").otherwise("MERGE")
    return e.select(
        F.col("user_id").alias("key"),
        (F.col("event_id") + FIRST_SEQ).alias("seq"),
        kind.alias("kind"),
        F.round(F.col("value") * 100).cast("long").alias("val"),
        F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
    )


def range_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range deletion per supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("start"), (k + 5).alias("stop"), (k * 60 + F.col("s_nationkey") * 100 + FIRST_SEQ).alias("seq"))


def range_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range key operation per supplier, its kind by the nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    return table(spark, sf_dir, "supplier").select(
        k.alias("start"),
        (k + 12).alias("stop"),
        (k * 60 + n * 100 + FIRST_SEQ + 5).alias("seq"),
        F.when(n % 4 < 2, "SET").when(n % 4 == 2, "UNSET").otherwise("DEL").alias("kind"),
        (n * 15 + 19800).alias("suffix"),
        F.round(F.col("s_acctbal") * 100).cast("long").alias("val"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in runs of 100 keys as the files of a store: level, bounds, sizes."""
    o = table(spark, sf_dir, "orders").withColumn("file_id", F.expr("o_orderkey div 100"))
    return o.groupBy("file_id").agg(
        F.min("o_orderkey").alias("smallest"),
        F.max("o_orderkey").alias("largest"),
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("bytes"),
    ).withColumn("level", F.col("file_id") % 7)


def separate(df: DataFrame, value: str, least: int) -> DataFrame:
    """df with where each value goes: place (blob or inline), inline (the value if it is short), size."""
    size = F.length(value)
    big = size >= least
    return df.withColumns({"place": F.when(big, "blob").otherwise("inline"), "inline": F.when(~big, F.col(value)), "size": size.cast("long")})


#: Profiles of compression by name, as Parquet codecs.
PROFILES = {"none": "uncompressed", "fastest": "lz4_raw", "fast": "snappy", "balanced": "zstd", "good": "zstd"}


def write_store(log: DataFrame, path: str, profile: str = "balanced", parts: int | None = None) -> None:
    """A store's files: dealt by key range and sorted, so scans prune by the files' bounds; what newer entries hide lies
    in a partition of its own, and a bloom filter on the key spares files to point reads."""
    newest = log.groupBy("key").agg(F.max("seq").alias("_newest"))
    marked = log.join(newest, "key").withColumn("obsolete", F.col("seq") < F.col("_newest")).drop("_newest")
    dealt = marked.repartitionByRange(parts, "key") if parts else marked.repartitionByRange("key")
    writer = dealt.sortWithinPartitions("obsolete", "key", "seq").write.mode("overwrite").partitionBy("obsolete")
    writer.option("compression", PROFILES[profile]).option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def read_store(spark: SparkSession, path: str, obsolete: bool = True) -> DataFrame:
    """A store's entries; without obsolete ones their partition isn't read. Merges fold older entries: read those whole."""
    df = spark.read.parquet(path)
    return df.drop("obsolete") if obsolete else df.where("not obsolete").drop("obsolete")


def block_intervals(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A property per file: the interval [lower, upper] of each column, to choose files before they are read."""
    df = spark.read.parquet(path).withColumn("file", F.input_file_name())
    return df.groupBy("file").agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lower"), (F.max, "upper"))])


def matching_files(intervals: DataFrame, column: str, lower: object, upper: object) -> DataFrame:
    """Files whose interval meets [lower, upper)."""
    return intervals.where((F.col(f"{column}_lower") < F.lit(upper)) & (F.col(f"{column}_upper") >= F.lit(lower))).select("file")
