"""Queries about levels, sizes and maintenance, and the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import stats
from millrace.plans.catalogue import FILES, LOG, query
from millrace.sources.tables import files, oplog, table

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _cents() -> F.Column:
    return F.round(F.col("o_totalprice") * 100).cast("long")


PLACED = "placed AS (SELECT *, CASE file_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'shared' ELSE 'external' END AS placement FROM files)"
IN_RANGE = "smallest <= 9050 AND largest >= 150"


@query(
    "disk_usage",
    f"""WITH {FILES}, {PLACED} SELECT level, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(bytes) FILTER (smallest >= 150 AND largest <= 9050), 0) AS BIGINT) AS whole_bytes,
CAST(coalesce(sum(bytes) FILTER (placement = 'local'), 0) AS BIGINT) AS local, CAST(coalesce(sum(bytes) FILTER (placement = 'shared'), 0) AS BIGINT) AS shared,
CAST(coalesce(sum(bytes) FILTER (placement = 'external'), 0) AS BIGINT) AS external, CAST(coalesce(sum(bytes) FILTER (placement <> 'local'), 0) AS BIGINT) AS remote
FROM placed WHERE {IN_RANGE} GROUP BY ROLLUP (level)""",
)
def disk_usage(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("file_id") % 3
    place = F.when(part == 0, "local").when(part == 1, "shared").otherwise("external")
    return stats.disk_usage(files(spark, d).withColumn("placement", place), 150, 9050)


@query(
    "approx_mid_key",
    f"""WITH {FILES}, f AS (SELECT least(largest, 9000) AS ends, sum(bytes) AS bytes FROM files WHERE smallest < 9000 AND largest >= 500 GROUP BY 1),
r AS (SELECT ends, sum(bytes) OVER (ORDER BY ends) AS run, sum(bytes) OVER () AS total FROM f),
h AS (SELECT min(run) AS run, any_value(total) // 2 AS half FROM r WHERE total > 2 * 900000000 AND run >= total // 2 - 900000000)
SELECT ends AS mid_key, CAST(r.run AS BIGINT) AS run FROM r JOIN h ON r.run = h.run WHERE r.run <= half + 900000000 AND ends > 500 AND ends < 9000""",
)
def approx_mid_key(spark: SparkSession, d: str) -> DataFrame:
    """The key that halves the bytes of a range, to within an error."""
    return stats.mid_key(files(spark, d).select("smallest", "largest", "bytes"), 500, 9000, 900_000_000)


LEVELS = f"""{FILES}, levels AS (SELECT level, count(*) * 1000000 + 1 AS bytes_in, CAST(coalesce(sum(bytes) FILTER (file_id % 5 = 0), 0) AS BIGINT) AS bytes_ingested,
  CASE WHEN level = 0 THEN CAST(sum(bytes) AS BIGINT) ELSE 0 END AS bytes_flushed, CASE WHEN level > 0 THEN CAST(sum(bytes) AS BIGINT) ELSE 0 END AS bytes_compacted FROM files GROUP BY level)"""


@query(
    "write_amp",
    f"""WITH {LEVELS}, u AS (SELECT level, bytes_in, bytes_flushed + bytes_compacted AS bytes_out FROM levels
UNION ALL SELECT NULL, CAST(123456 + sum(bytes_ingested) AS BIGINT), CAST(sum(bytes_flushed) + sum(bytes_compacted) + 123456 + sum(bytes_ingested) AS BIGINT) FROM levels)
SELECT level, bytes_in, bytes_out, CASE WHEN bytes_in = 0 THEN 0.0 ELSE CAST(bytes_out AS DOUBLE) / bytes_in END AS write_amp FROM u""",
)
def write_amp(spark: SparkSession, d: str) -> DataFrame:
    of = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("bytes"))), F.lit(0)).alias(name)
    per = files(spark, d).groupBy("level").agg((F.count(F.lit(1)) * 1_000_000 + 1).alias("bytes_in"), of(F.col("file_id") % 5 == 0, "bytes_ingested"), of(F.col("level") == 0, "bytes_flushed"), of(F.col("level") > 0, "bytes_compacted"))
    return stats.write_amplification(per, 123_456)


SIZED = f"""{FILES}, per AS (SELECT level, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(bytes) // 7 AS BIGINT) AS deletion_bytes, count(*) AS files, count(*) // 4 AS depth,
  CAST(1000000000 * 3 ** level AS BIGINT) AS target FROM files GROUP BY level),
fills AS (SELECT level, CASE WHEN level = 0 THEN greatest(2.0 * depth / 4, files / 500.0) ELSE CAST(bytes AS DOUBLE) / target END AS fill,
  CASE WHEN level = 0 THEN greatest(2.0 * depth / 4, files / 500.0) ELSE CAST(bytes + deletion_bytes AS DOUBLE) / target END AS compensated FROM per WHERE level = 0 OR level >= 2),
pairs AS (SELECT a.*, greatest(0.01, coalesce(b.fill, 0)) AS below FROM fills a LEFT JOIN fills b ON b.level = CASE WHEN a.level = 0 THEN 2 ELSE a.level + 1 END)"""


@query(
    "level_scores",
    f"""WITH {SIZED} SELECT level, round(fill, 9) AS fill, round(compensated, 9) AS compensated,
round(CASE WHEN compensated < 1 OR level = 0 AND compensated / below < 1 THEN 0 WHEN level = 6 THEN fill ELSE fill / below END, 6) AS score FROM pairs""",
)
def level_scores(spark: SparkSession, d: str) -> DataFrame:
    target = (F.pow(F.lit(3), F.col("level")) * 1_000_000_000).cast("long")
    n = F.count(F.lit(1))
    per = files(spark, d).groupBy("level").agg(F.sum("bytes").alias("bytes"), F.expr("sum(bytes) div 7").alias("deletion_bytes"), n.alias("files"), F.expr("count(1) div 4").alias("depth"))
    out = stats.level_scores(per.withColumn("target", target), base_level=2)
    return out.select("level", F.round("fill", 9).alias("fill"), F.round("compensated", 9).alias("compensated"), F.round("score", 6).alias("score"))


TOTALS = """o AS (SELECT o_orderkey // 100 AS file_id, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderstatus = 'F' AS del, o_orderkey AS k FROM orders),
t AS (SELECT file_id, CAST(sum(v) AS BIGINT) AS bytes, CAST(sum(v) AS BIGINT) AS raw_values, count(*) * 8 AS raw_keys, count(*) AS entries, count(*) FILTER (del) AS deletions,
  count(*) FILTER (del AND k % 2 = 0) AS sized_deletions, 8 * count(*) FILTER (del) AS tombstone_keys, CAST(coalesce(sum(v) FILTER (del AND k % 2 = 0), 0) AS BIGINT) AS sized_hints FROM o GROUP BY 1),
x AS (SELECT a.*, coalesce(b.bytes, 0) AS bb, coalesce(b.raw_keys, 0) AS bk, coalesce(b.raw_values, 0) AS bv, coalesce(b.entries, 0) AS be, coalesce(b.deletions, 0) AS bd FROM t a LEFT JOIN t b ON b.file_id = a.file_id + 1),
y AS (SELECT *, CAST(raw_values + bv AS DOUBLE) / greatest(entries + be - deletions - bd, 1) AS avg_value, least(1.0, CAST(bytes + bb AS DOUBLE) / (raw_keys + bk + raw_values + bv)) AS ratio FROM x)"""


@query(
    "table_stats",
    f"""WITH {TOTALS} SELECT file_id, round(avg_value, 3) AS avg_value, round(ratio, 9) AS ratio, CASE WHEN deletions = 0 THEN 0 ELSE
CAST(floor((tombstone_keys + sized_hints + (deletions - sized_deletions) * (CAST(tombstone_keys AS DOUBLE) / deletions + avg_value)) * ratio) AS BIGINT) END AS freed FROM y""",
)
def table_stats(spark: SparkSession, d: str) -> DataFrame:
    """What the deletions of each file will free, by the averages of the file and the one beneath."""
    gone, even, v = F.col("o_orderstatus") == "F", F.col("o_orderkey") % 2 == 0, _cents()
    t = table(spark, d, "orders").groupBy(F.expr("o_orderkey div 100").alias("file_id")).agg(
        F.sum(v).alias("bytes"), F.sum(v).alias("raw_values"), (F.count(F.lit(1)) * 8).alias("raw_keys"), F.count(F.lit(1)).alias("entries"), F.count_if(gone).alias("deletions"),
        F.count_if(gone & even).alias("sized_deletions"), (F.count_if(gone) * 8).alias("tombstone_keys"), F.coalesce(F.sum(F.when(gone & even, v)), F.lit(0)).alias("sized_hints"),
    )
    names = ["bytes", "raw_keys", "raw_values", "entries", "deletions"]
    low = t.select((F.col("file_id") - 1).alias("file_id"), *[F.col(c).alias(f"below_{c}") for c in names])
    out = stats.deletion_estimates(t.join(low, "file_id", "left").na.fill(0))
    return out.select("file_id", F.round("avg_value", 3).alias("avg_value"), F.round("ratio", 9).alias("ratio"), "freed")


@query(
    "tier_bytes",
    """WITH v AS (SELECT l_returnflag AS tier, l_suppkey % 50 AS a, CAST(l_quantity AS BIGINT) AS q FROM lineitem) SELECT tier, CAST(sum(q) AS BIGINT) AS total, CAST(coalesce(sum(q) FILTER (a = 0), 0) AS BIGINT) AS no_attribute,
CAST(coalesce(sum(q) FILTER (a <> 0 AND a <= 20), 0) AS BIGINT) AS below, CAST(coalesce(sum(q) FILTER (a > 20), 0) AS BIGINT) AS above FROM v GROUP BY tier""",
)
def tier_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes at or below a tier's threshold and above, without those that have no attribute."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tier"), (F.col("l_suppkey") % 50).alias("a"), F.col("l_quantity").cast("long").alias("q"))
    return stats.tiering(rows, ["tier"], "a", "q", 20)


@query("table_properties", "SELECT l_linenumber AS level, count(*) AS n, min(l_orderkey) AS smallest, max(l_orderkey) AS largest, count(DISTINCT l_partkey) AS n_prefixes FROM lineitem GROUP BY l_linenumber")
def table_properties(spark: SparkSession, d: str) -> DataFrame:
    return stats.table_properties(table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "level"), "level", "l_orderkey", "l_partkey")


@query("metadata_percentiles", "SELECT lang, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, round(avg(n_chars), 6) AS mean, round(coalesce(stddev_samp(n_chars), 0), 6) AS stddev FROM documents GROUP BY lang")
def metadata_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_summary(table(spark, d, "documents"), ["lang"], "n_chars")


@query(
    "weighted_summary",
    """WITH s AS (SELECT l_returnflag AS flag, sum(l_quantity) AS n, sum(l_quantity * l_discount) AS s, sum(l_quantity * l_discount * l_discount) AS q FROM lineitem GROUP BY 1)
SELECT flag, round(s / n, 9) AS mean, round(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 9) AS stddev, round(n, 3) AS weight FROM s""",
)
def weighted_summary(spark: SparkSession, d: str) -> DataFrame:
    out = stats.weighted_summary(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_discount", "l_quantity")
    return out.select("flag", F.round("mean", 9).alias("mean"), F.round("stddev", 9).alias("stddev"), F.round("weight", 3).alias("weight"))


@query("rate_deltas", f"WITH {LOG} SELECT key, seq, greatest(val - lag(val) OVER (PARTITION BY key ORDER BY seq), 0) AS delta FROM log")
def rate_deltas(spark: SparkSession, d: str) -> DataFrame:
    return oplog(spark, d).select("key", "seq", stats.rate_deltas(None, "key", "seq", "val").alias("delta"))


@query(
    "sampled_metric",
    f"""WITH {LOG}, e AS (SELECT min(seq) AS lo, max(seq) AS hi FROM log), b AS (SELECT least((seq - lo) * 16 // greatest(hi - lo, 1), 15) AS bucket, arg_max(val, seq) AS v FROM log, e WHERE seq % 1000 < 40 OR seq IN (lo, hi) GROUP BY 1)
SELECT CAST(g AS INT) AS bucket, (SELECT arg_min(v, bucket) FROM b WHERE bucket >= g) AS value FROM range(16) t(g)""",
)
def sampled_metric(spark: SparkSession, d: str) -> DataFrame:
    """A metric in sixteen equal parts of its time."""
    log = oplog(spark, d)
    ends = log.agg(F.array(F.min("seq"), F.max("seq"))).scalar()
    return stats.sampled(log.withColumn("_e", ends).where("seq % 1000 < 40 or array_contains(_e, seq)").drop("_e"), "seq", "val", 16)


@query("key_categories", "SELECT CASE WHEN c_custkey < 100 THEN 'system' WHEN c_custkey < 500 THEN 'meta' WHEN c_custkey < 1000 THEN 'user' ELSE 'other' END AS category, count(*) AS n FROM customer GROUP BY 1")
def key_categories(spark: SparkSession, d: str) -> DataFrame:
    bounds = [(100, "system"), (500, "meta"), (1000, "user"), (None, "other")]
    c = table(spark, d, "customer")
    return c.groupBy(stats.categories(c, "c_custkey", bounds).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("category_stats", "SELECT l_returnflag AS category, count(*) AS reads, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS cached FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def category_stats(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "category").rollup("category").agg(F.count(F.lit(1)).alias("reads"), F.sum(q).alias("bytes"), F.sum(F.when(F.col("l_linestatus") == "O", q).otherwise(0)).alias("cached"))


# Maintenance logs. The lines are written from the orders, as a store writes them; the SQL reads the orders.


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr("timestamp_seconds(1700000000 + o_orderkey * 7)").alias("at"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stamp = lambda more: F.concat(F.date_format(F.expr(f"at + make_dt_interval(0, 0, 0, {more})"), "yyMMdd HH:mm:ss"), F.lit(".000000"))
    head = lambda more: F.format_string("I%s 51831533 3@store/compaction.go:1845 - [n%d,kv,s%d] 12  [JOB %d] ", stamp(more), c % 3 + 1, c % 2 + 1, k)
    kind = F.element_at(F.array(*map(F.lit, ("default", "move", "delete-only", "elision-only"))), (k % 4 + 1).cast("int"))
    into = F.format_string("L%d [%d] (%dMB) + L%d [%d] (%dKB)", k % 5 + 1, k, c % 90 + 1, k % 5 + 2, k + 1, c % 50 + 1)
    job = k % 10
    lines = F.when(job < 6, F.array(
        F.concat(head("0"), F.format_string("compacting(%s) %s", kind, into)),
        F.when(job < 5, F.concat(head("o_custkey % 50"), F.format_string("compacted(%s) %s -> L%d [%d %d] (%dMB), in 0.3s (0.4s total), output rate 42MB/s", kind, into, k % 5 + 2, k + 2, k + 3, c % 80 + 1))),
    )).when(job < 8, F.array(
        F.concat(head("0"), F.lit("flushing 2 memtables (1.4MB)  to L0")),
        F.concat(head("o_custkey % 20"), F.format_string("flushed 2 memtables (1.4MB) to L0 [%d] (%dKB), in 0.2s, output rate 5.8MB/s", k, c % 70 + 1)),
    )).when(job == 8, F.array(
        F.concat(head("0"), F.format_string("ingested L0:%d (%dKB), L6:%d (%dMB)", k, c % 9 + 1, k + 1, c % 5 + 1)),
    )).otherwise(F.array(F.concat(head("0"), F.lit("sstable created 12"))))
    return o.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))


EVENTS = """j AS (SELECT o_orderkey AS k, o_custkey AS c, 1700000000 + o_orderkey * 7 AS began FROM orders),
ev AS (SELECT c % 3 + 1 AS node, c % 2 + 1 AS store, k AS job, CASE k % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'move' WHEN 2 THEN 'delete-only' ELSE 'elision-only' END AS type, CAST(k % 5 + 1 AS INT) AS from_level, CAST(k % 5 + 2 AS INT) AS to_level,
  began, began + c % 50 AS ended, (c % 90 + 1) * 1048576 + (c % 50 + 1) * 1024 AS bytes_in, (c % 80 + 1) * 1048576 AS bytes_out FROM j WHERE k % 10 < 5
UNION ALL SELECT c % 3 + 1, c % 2 + 1, k, 'flush', NULL, 0, began, began + c % 20, 0, (c % 70 + 1) * 1024 FROM j WHERE k % 10 IN (6, 7)
UNION ALL SELECT c % 3 + 1, c % 2 + 1, k, 'ingest', NULL, 0, began, began, 0, (c % 9 + 1) * 1024 FROM j WHERE k % 10 = 8
UNION ALL SELECT c % 3 + 1, c % 2 + 1, k, 'ingest', NULL, 6, began, began, 0, (c % 5 + 1) * 1048576 FROM j WHERE k % 10 = 8)"""


@query("parse_maintenance_log", f"WITH {EVENTS} SELECT node, store, job, type, from_level, to_level, began, ended, bytes_in, bytes_out FROM ev")
def parse_maintenance_log(spark: SparkSession, d: str) -> DataFrame:
    """Jobs read from log lines: compactions and flushes paired by node, store and job, ingestions by file."""
    got = stats.maintenance_events(log_lines(spark, d))
    return got.withColumns({c: F.unix_seconds(c) for c in ("began", "ended")})


@query(
    "maintenance_windows",
    f"""WITH {EVENTS}, w AS (SELECT *, began // 600 AS w, began % 600 = 0 AS edge FROM ev), opened AS (SELECT DISTINCT node, store, w + 1 AS w FROM w WHERE NOT edge),
p AS (SELECT w.*, CASE WHEN w.edge AND o.w IS NOT NULL THEN w.w - 1 ELSE w.w END * 600 AS win FROM w LEFT JOIN opened o ON o.node = w.node AND o.store = w.store AND o.w = w.w)
SELECT node, store, win, type, from_level, to_level, count(*) AS n, CAST(sum(CASE WHEN type IN ('move', 'delete-only') THEN 0 ELSE bytes_in END) AS BIGINT) AS bytes_in,
CAST(sum(CASE WHEN type IN ('move', 'delete-only') THEN 0 ELSE bytes_out END) AS BIGINT) AS bytes_out, CAST(sum(CASE WHEN type = 'move' THEN bytes_in ELSE 0 END) AS BIGINT) AS bytes_moved,
CAST(sum(CASE WHEN type = 'delete-only' THEN bytes_in ELSE 0 END) AS BIGINT) AS bytes_deleted, CAST(sum(ended - began) AS DOUBLE) AS seconds, count(*) FILTER (ended - began > 30) AS long_running FROM p GROUP BY ALL""",
)
def maintenance_windows(spark: SparkSession, d: str) -> DataFrame:
    """Jobs in windows of ten minutes by node and store; those of over thirty seconds count as long."""
    got = stats.maintenance_windows(stats.maintenance_events(log_lines(spark, d)), 600, 30)
    return got.withColumn("win", F.unix_seconds("window")).drop("window")


EDITS = f"""edits AS (SELECT o_orderkey // 6 AS edit_no, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'add' END AS action, o_orderkey % 7 AS level,
  CASE WHEN o_orderstatus = 'F' THEN greatest(o_orderkey - 300, 1) ELSE o_orderkey END AS file_id, {CENTS} AS bytes, 1700000000 + (o_orderkey * 37) % 5000 * 60 AS created_at FROM orders
UNION ALL SELECT o_orderkey // 6, 'backing', 0, o_orderkey, 0, 0 FROM orders WHERE o_orderkey % 31 = 0)"""


@query(
    "manifest_summary",
    f"""WITH {EDITS}, e AS (SELECT edit_no, bool_or(action = 'add') AND bool_or(action = 'delete') AND NOT bool_or(action = 'backing') AS compaction,
  max(CASE WHEN action = 'add' AND created_at > 0 THEN created_at END) AS created, arg_min(level, file_id) FILTER (action = 'add') AS first FROM edits GROUP BY edit_no),
n AS (SELECT *, max(created) OVER (ORDER BY edit_no) AS newest, row_number() OVER (ORDER BY edit_no) AS r FROM e),
known AS (SELECT file_id, arg_max(bytes, edit_no) AS bytes FROM edits WHERE action = 'add' GROUP BY 1),
x AS (SELECT d.*, n.newest // 3600 * 3600 AS bucket, compaction, compaction AND NOT coalesce(first = 0, FALSE) AS moved, k.bytes AS held FROM edits d JOIN n ON n.edit_no = d.edit_no AND r > 1 AND newest IS NOT NULL LEFT JOIN known k ON k.file_id = d.file_id WHERE action <> 'backing')
SELECT bucket, level, CAST(coalesce(sum(bytes) FILTER (action = 'add' AND NOT compaction), 0) AS BIGINT) AS added, CAST(coalesce(sum(bytes) FILTER (action = 'add' AND moved), 0) AS BIGINT) AS compacted_in,
count(*) FILTER (action = 'add' AND moved) AS files_in, CAST(coalesce(sum(held) FILTER (action = 'delete' AND moved AND level <> 6), 0) AS BIGINT) AS compacted_out FROM x GROUP BY ALL""",
)
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that edits of a manifest add and compactions move, per hour and level."""
    k, gone = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    o, no = table(spark, d, "orders"), F.expr("o_orderkey div 6").alias("edit_no")
    edits = o.select(no, F.when(gone, "delete").otherwise("add").alias("action"), (k % 7).alias("level"), F.when(gone, F.greatest(k - 300, F.lit(1))).otherwise(k).alias("file_id"), _cents().alias("bytes"), (F.lit(1_700_000_000) + (k * 37) % 5000 * 60).alias("created_at"))
    zero = F.lit(0).cast("long")
    edits = edits.unionByName(o.where("o_orderkey % 31 = 0").select(no, F.lit("backing").alias("action"), zero.alias("level"), k.alias("file_id"), zero.alias("bytes"), zero.alias("created_at")))
    return stats.manifest_summary(edits, 3600).withColumn("bucket", F.unix_seconds("bucket"))


@query("version_history", "WITH e AS (SELECT o_orderkey // 50 AS edit_no, o_orderkey % 7 AS level, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS d FROM orders), g AS (SELECT edit_no, level, sum(d) AS d FROM e GROUP BY ALL) SELECT edit_no, level, CAST(sum(d) OVER (PARTITION BY level ORDER BY edit_no) AS BIGINT) AS live FROM g")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    """Files of each level after every edit."""
    o = table(spark, d, "orders")
    return stats.live_counts(o.select(F.expr("o_orderkey div 50").alias("edit_no"), (F.col("o_orderkey") % 7).alias("level"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("d")))
