"""Queries over the driver's tables, and the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import keys
from millrace.operators import maintain, spans, stats, view, write
from millrace.sources.tables import files, oplog, range_deletions, range_keys, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Snapshots lie at tenths of a log: those of the compaction queries, and the one of the reads.
THIRDS, MIDDLE = (3, 6), 4


def at(log: DataFrame, tenths: int) -> Column:
    """A snapshot at so many tenths of the log's numbers, read with the query."""
    return log.agg(F.expr(f"max(seq) * {tenths} div 10")).scalar()


def at_sql(tenths: int) -> str:
    return f"(SELECT max(seq) * {tenths} // 10 FROM log)"


def stripes(log: DataFrame) -> list[Column]:
    return [at(log, k) for k in THIRDS]



LOG = """log AS (SELECT user_id AS key, event_id + 10 AS seq,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'SET' WHEN event_type = 'error' THEN 'DEL' ELSE 'MERGE' END AS kind,
  CAST(round(value * 100) AS BIGINT) AS val, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events)"""
DELS = "dels AS (SELECT s_suppkey AS start, s_suppkey + 5 AS stop, s_suppkey * 60 + s_nationkey * 100 + 10 AS seq FROM supplier)"
MARKS = """marks AS (SELECT s_suppkey AS start, s_suppkey + 12 AS stop, s_suppkey * 60 + s_nationkey * 100 + 15 AS seq,
  CASE WHEN s_nationkey % 4 < 2 THEN 'SET' WHEN s_nationkey % 4 = 2 THEN 'UNSET' ELSE 'DEL' END AS kind,
  19800 + s_nationkey * 15 AS suffix, CAST(round(s_acctbal * 100) AS BIGINT) AS val FROM supplier)"""
FILES = """files AS (SELECT o_orderkey // 100 AS file_id, min(o_orderkey) AS smallest, max(o_orderkey) AS largest, count(*) AS entries,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS bytes, (o_orderkey // 100) % 7 AS level FROM orders GROUP BY o_orderkey // 100)"""
FRAGS = """cuts AS (SELECT start AS edge FROM marks UNION SELECT stop FROM marks),
frags AS (SELECT c.edge AS start, (SELECT min(edge) FROM cuts x WHERE x.edge > c.edge) AS stop, m.seq, m.kind, m.suffix, m.val
  FROM marks m JOIN cuts c ON c.edge >= m.start AND c.edge < m.stop)"""
COAL = """dead AS (SELECT *, coalesce(max(CASE WHEN kind = 'DEL' THEN seq END) OVER (PARTITION BY start, stop), -1) AS dead FROM frags),
ranked AS (SELECT *, row_number() OVER (PARTITION BY start, stop, suffix ORDER BY seq DESC, CASE WHEN kind = 'SET' THEN 0 ELSE 1 END, val DESC) AS r
  FROM dead WHERE kind <> 'DEL' AND seq >= dead),
coal AS (SELECT start, stop, suffix, val, seq FROM ranked WHERE r = 1 AND kind = 'SET')"""


def resolved(log: str, dels: str | None, out: str = "resolved") -> str:
    cover = f"WHERE NOT EXISTS (SELECT 1 FROM {dels} d WHERE l.key >= d.start AND l.key < d.stop AND d.seq > l.seq)" if dels else ""
    return f"""left_ AS (SELECT * FROM {log} l {cover}),
bars AS (SELECT *, coalesce(max(CASE WHEN kind <> 'MERGE' THEN seq END) OVER (PARTITION BY key), -1) AS bar FROM left_),
{out} AS (SELECT key, CAST(sum(val) AS BIGINT) AS val, string_agg(CAST(val AS VARCHAR), ',' ORDER BY seq) AS trail, count(*) AS n, max(seq) AS seq
  FROM bars WHERE seq >= bar AND kind IN ('SET', 'SETWITHDEL', 'MERGE') GROUP BY key)"""


def cut_sql(src: str, columns: str, out: str = "frags") -> str:
    """Fragments of spans: every span at every boundary in it."""
    return f"""cuts_{out} AS (SELECT start AS edge FROM {src} UNION SELECT stop FROM {src}),
{out} AS (SELECT c.edge AS start, (SELECT min(edge) FROM cuts_{out} x WHERE x.edge > c.edge) AS stop, {columns} FROM {src} m JOIN cuts_{out} c ON c.edge >= m.start AND c.edge < m.stop)"""


STRIPE = f"CAST(seq >= {at_sql(3)} AS INT) + CAST(seq >= {at_sql(6)} AS INT) AS stripe"


def query(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("latest_state", f"WITH {LOG}, {DELS}, {resolved('log', 'dels')} SELECT * FROM resolved")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """Every key as the newest entry leaves it, with the operands that it folds."""
    return view.resolve(oplog(spark, d), range_deletions(spark, d), trail=True)


@query("snapshot_read", f"WITH {LOG}, old AS (SELECT * FROM log WHERE seq < {at_sql(MIDDLE)}), {resolved('old', None)} SELECT key, val, n FROM resolved")
def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    log = oplog(spark, d)
    return view.resolve(log, None, at(log, MIDDLE)).select("key", "val", "n")


@query(
    "snapshot_diff",
    f"""WITH {LOG}, o AS (SELECT * FROM log WHERE seq < {at_sql(MIDDLE)}), {resolved("o", None, "a")},
left_2 AS (SELECT * FROM log), bars2 AS (SELECT *, coalesce(max(CASE WHEN kind <> 'MERGE' THEN seq END) OVER (PARTITION BY key), -1) AS bar FROM left_2),
b AS (SELECT key, CAST(sum(val) AS BIGINT) AS val FROM bars2 WHERE seq >= bar AND kind IN ('SET', 'MERGE') GROUP BY key)
SELECT coalesce(a.key, b.key) AS key, a.val AS before, b.val AS after FROM a FULL JOIN b ON a.key = b.key WHERE a.val IS DISTINCT FROM b.val""",
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose value differs between a snapshot and now."""
    log = oplog(spark, d)
    a = view.resolve(log, None, at(log, MIDDLE)).select("key", F.col("val").alias("before"))
    b = view.resolve(log).select("key", F.col("val").alias("after"))
    return a.join(b, "key", "full").where(~F.col("before").eqNullSafe(F.col("after")))


@query("point_get", f"WITH {LOG}, one AS (SELECT * FROM log WHERE key = 7), {resolved('one', None)} SELECT key, val, trail FROM resolved")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return view.resolve(oplog(spark, d).where("key = 7"), trail=True).select("key", "val", "trail")


@query("multi_get", f"WITH {LOG}, chosen AS (SELECT * FROM log WHERE key IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), {resolved('chosen', None)} SELECT key, val FROM resolved")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return view.resolve(oplog(spark, d).join(wanted, "key", "left_semi")).select("key", "val")


BATCH = "batch AS (SELECT o_custkey AS key, o_orderkey + 36028797018963968 AS seq, 'MERGE' AS kind, CAST(round(o_totalprice * 100) AS BIGINT) AS val, 0 AS day FROM orders)"


def _batch(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit("MERGE").alias("kind"), F.round(F.col("o_totalprice") * 100).cast("long").alias("val"), F.lit(0).cast("long").alias("day"))


@query("batch_overlay", f"WITH {LOG}, {BATCH}, both_ AS (SELECT * FROM log UNION ALL SELECT * FROM batch), {resolved('both_', None)} SELECT key, val, n FROM resolved")
def batch_overlay(spark: SparkSession, d: str) -> DataFrame:
    return view.resolve(view.overlay(oplog(spark, d), _batch(spark, d))).select("key", "val", "n")


@query("batch_only", f"WITH {BATCH}, {resolved('batch', None)} SELECT key, val, n FROM resolved")
def batch_only(spark: SparkSession, d: str) -> DataFrame:
    return view.resolve(_batch(spark, d)).select("key", "val", "n")


@query(
    "external_merge",
    f"WITH {LOG}, p AS (SELECT *, seq % 2 AS priority FROM log) SELECT key, priority, seq, val FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, seq DESC) AS r FROM p) WHERE r = 1 AND kind <> 'DEL'",
)
def external_merge(spark: SparkSession, d: str) -> DataFrame:
    log = oplog(spark, d).withColumn("priority", F.col("seq") % 2)
    return view.newest(log, ["key"], [-F.col("priority"), F.col("seq")]).where("kind != 'DEL'").select("key", "priority", "seq", "val")


@query("internal_scan", f"WITH {LOG} SELECT key, seq, kind, val FROM log WHERE key BETWEEN 10 AND 29")
def internal_scan(spark: SparkSession, d: str) -> DataFrame:
    return oplog(spark, d).where("key between 10 and 29").select("key", "seq", "kind", "val")


PLAIN = "plain AS (SELECT key, seq, CASE WHEN kind = 'MERGE' THEN 'SET' ELSE kind END AS kind, val FROM log)"


def _beneath(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = oplog(spark, d)
    plain = log.select("key", "seq", F.when(F.col("kind") == "MERGE", "SET").otherwise(F.col("kind")).alias("kind"), "val")
    return view.internal_scan(plain, range_deletions(spark, d), range_keys(spark, d), at(log, MIDDLE))


@query(
    "internal_scan_points",
    f"""WITH {LOG}, {DELS}, {PLAIN}, s AS (SELECT * FROM plain l WHERE seq < {at_sql(MIDDLE)} AND NOT EXISTS (SELECT 1 FROM dels d WHERE d.seq < {at_sql(MIDDLE)} AND l.key >= d.start AND l.key < d.stop AND d.seq > l.seq))
SELECT key, seq, kind, val FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM s) WHERE r = 1""",
)
def internal_scan_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of a scan below the surface at a snapshot: newest entries, deletions too."""
    return _beneath(spark, d)[0].select("key", "seq", "kind", "val")


@query("internal_scan_deletions", f"WITH {LOG}, {DELS}, sdels AS (SELECT * FROM dels WHERE seq < {at_sql(MIDDLE)}), {cut_sql('sdels', 'm.seq')} SELECT start, stop, max(seq) AS seq FROM frags GROUP BY ALL")
def internal_scan_deletions(spark: SparkSession, d: str) -> DataFrame:
    return _beneath(spark, d)[1]


@query(
    "internal_scan_range_keys",
    f"""WITH {LOG}, {MARKS}, smarks AS (SELECT * FROM marks WHERE seq < {at_sql(MIDDLE)}), {cut_sql('smarks', 'm.seq, m.kind, m.suffix, m.val')},
dead AS (SELECT *, coalesce(max(CASE WHEN kind = 'DEL' THEN seq END) OVER (PARTITION BY start, stop), -1) AS dead FROM frags),
r AS (SELECT *, row_number() OVER (PARTITION BY start, stop, kind = 'DEL', CASE WHEN kind = 'DEL' THEN 0 ELSE suffix END ORDER BY seq DESC, CASE WHEN kind = 'SET' THEN 0 ELSE 1 END, val DESC) AS r FROM dead WHERE seq >= dead)
SELECT start, stop, kind, CASE WHEN kind <> 'DEL' THEN suffix END AS suffix, seq FROM r WHERE r = 1""",
)
def internal_scan_range_keys(spark: SparkSession, d: str) -> DataFrame:
    return _beneath(spark, d)[2].select("start", "stop", "kind", "suffix", "seq")


@query("bounded_scan", f"WITH {LOG}, chosen AS (SELECT * FROM log WHERE key >= 20 AND key < 60), {resolved('chosen', None)} SELECT key, val FROM resolved ORDER BY key")
def bounded_scan(spark: SparkSession, d: str) -> DataFrame:
    return view.resolve(oplog(spark, d).where("key >= 20 and key < 60")).select("key", "val").orderBy("key")


@query("reverse_scan_limit", f"WITH {LOG}, {resolved('log', None)} SELECT key, val FROM resolved ORDER BY key DESC LIMIT 20")
def reverse_scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return view.resolve(oplog(spark, d)).select("key", "val").orderBy(F.col("key").desc()).limit(20)


@query("first_last", f"WITH {LOG}, {resolved('log', None)} SELECT min(key) AS first_key, max(key) AS last_key, arg_min(val, key) AS first_val, arg_max(val, key) AS last_val FROM resolved")
def first_last(spark: SparkSession, d: str) -> DataFrame:
    v = view.resolve(oplog(spark, d))
    return v.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min_by("val", "key").alias("first_val"), F.max_by("val", "key").alias("last_val"))


PROBES = "probes AS (SELECT DISTINCT l_partkey * 3 AS probe FROM lineitem), ks AS (SELECT DISTINCT o_orderkey * 7 AS key FROM orders)"


def _seek(spark: SparkSession, d: str, forward: bool) -> DataFrame:
    probes = table(spark, d, "lineitem").select((F.col("l_partkey") * 3).alias("probe")).distinct()
    ks = table(spark, d, "orders").select((F.col("o_orderkey") * 7).alias("key")).distinct()
    return view.seek(ks, probes, forward)


@query("seek_ge_batch", f"WITH {PROBES} SELECT probe, min(key) AS found FROM probes LEFT JOIN ks ON key >= probe GROUP BY probe")
def seek_ge_batch(spark: SparkSession, d: str) -> DataFrame:
    return _seek(spark, d, True)


@query("seek_lt_batch", f"WITH {PROBES} SELECT probe, max(key) AS found FROM probes LEFT JOIN ks ON key < probe GROUP BY probe")
def seek_lt_batch(spark: SparkSession, d: str) -> DataFrame:
    return _seek(spark, d, False)


@query("prefix_scan", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 5 AND turn >= 1")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("conv_id = 5 and turn >= 1").select("conv_id", "turn", "role")


NEWEST = "row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)"


def _line_order() -> list[Column]:
    """The newest ship date, then the smallest of the rest: the largest of these columns."""
    return [F.col("l_shipdate"), *[-F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]]


@query("next_prefix", f"SELECT l_partkey, l_shipdate, l_orderkey, l_quantity FROM (SELECT *, {NEWEST} AS r FROM lineitem) WHERE r = 1")
def next_prefix(spark: SparkSession, d: str) -> DataFrame:
    return view.newest(table(spark, d, "lineitem"), ["l_partkey"], _line_order()).select("l_partkey", "l_shipdate", "l_orderkey", "l_quantity")


@query("mvcc_scan_asof", f"SELECT l_partkey, l_shipdate, l_orderkey, l_quantity FROM (SELECT *, {NEWEST} AS r FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-01-01') WHERE r = 1")
def mvcc_scan_asof(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1996-01-01").cast("timestamp_ntz"))
    return view.newest(old, ["l_partkey"], _line_order()).select("l_partkey", "l_shipdate", "l_orderkey", "l_quantity")


@query("time_filtered_scan", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01'")
def time_filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    hit = (F.col("l_shipdate") >= at("1995-01-01")) & (F.col("l_shipdate") < at("1995-02-01"))
    return table(spark, d, "lineitem").where(hit).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("rangedel_cover", f"WITH {LOG}, {DELS} SELECT key, seq FROM log l WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE l.key >= d.start AND l.key < d.stop AND d.seq > l.seq)")
def rangedel_cover(spark: SparkSession, d: str) -> DataFrame:
    return view.delete_ranges(oplog(spark, d), range_deletions(spark, d)).select("key", "seq")


@query("span_fragments", f"WITH {MARKS}, {FRAGS} SELECT start, stop, seq, kind, suffix, val FROM frags")
def span_fragments(spark: SparkSession, d: str) -> DataFrame:
    return spans.fragments(range_keys(spark, d))


@query("rangekey_coalesce", f"WITH {MARKS}, {FRAGS}, {COAL} SELECT start, stop, suffix, val, seq FROM coal")
def rangekey_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return spans.coalesce(spans.fragments(range_keys(spark, d))).select("start", "stop", "suffix", "val", "seq")


@query(
    "rangekey_defragment",
    f"""WITH {MARKS}, {FRAGS}, {COAL}, per AS (SELECT start, stop, string_agg(suffix || '=' || val, ',' ORDER BY suffix, val) AS state FROM coal GROUP BY start, stop),
runs AS (SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY state ORDER BY start) = start THEN 0 ELSE 1 END AS new FROM per),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY state ORDER BY start) AS run FROM runs)
SELECT state, min(start) AS start, max(stop) AS stop FROM numbered GROUP BY state, run""",
)
def rangekey_defragment(spark: SparkSession, d: str) -> DataFrame:
    return spans.defragment(spans.coalesce(spans.fragments(range_keys(spark, d))))


@query(
    "combined_iteration",
    f"""WITH {LOG}, {MARKS}, {FRAGS}, {COAL}, {resolved("log", None)}, sp AS (SELECT DISTINCT start, stop FROM coal)
SELECT r.key, TRUE AS has_point, s.start IS NOT NULL AS has_range, r.val, s.start AS range_start, s.stop AS range_end FROM resolved r LEFT JOIN sp s ON r.key >= s.start AND r.key < s.stop
UNION ALL SELECT s.start, FALSE, TRUE, NULL, s.start, s.stop FROM sp s WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.key = s.start)""",
)
def combined_iteration(spark: SparkSession, d: str) -> DataFrame:
    points = view.resolve(oplog(spark, d)).select("key", "val")
    return view.combined(points, spans.coalesce(spans.fragments(range_keys(spark, d))))


@query(
    "combined_bounded",
    f"""WITH {LOG}, {MARKS}, {FRAGS}, {COAL}, {resolved("log", None)}, sp AS (SELECT DISTINCT greatest(start, 20) AS start, least(stop, 60) AS stop FROM coal WHERE greatest(start, 20) < least(stop, 60)),
p AS (SELECT * FROM resolved WHERE key >= 20 AND key < 60)
SELECT r.key, TRUE AS has_point, s.start IS NOT NULL AS has_range, r.val, s.start AS range_start, s.stop AS range_end FROM p r LEFT JOIN sp s ON r.key >= s.start AND r.key < s.stop
UNION ALL SELECT s.start, FALSE, TRUE, NULL, s.start, s.stop FROM sp s WHERE NOT EXISTS (SELECT 1 FROM p r WHERE r.key = s.start)""",
)
def combined_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Points and range keys between bounds; spans are clipped to them."""
    points = view.resolve(oplog(spark, d)).select("key", "val")
    return view.combined(points, spans.coalesce(spans.fragments(range_keys(spark, d))), 20, 60)


@query("ranges_only", f"WITH {MARKS}, {FRAGS}, {COAL} SELECT DISTINCT start AS key, start AS range_start, stop AS range_end FROM coal")
def ranges_only(spark: SparkSession, d: str) -> DataFrame:
    """An iterator over range keys alone."""
    points = view.resolve(oplog(spark, d)).select("key", "val")
    return view.combined(points, spans.coalesce(spans.fragments(range_keys(spark, d))), kinds="ranges").select("key", "range_start", "range_end")


@query(
    "rangekey_mask",
    f"""WITH {LOG}, {MARKS}
SELECT key, seq, day FROM log l WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.kind = 'SET' AND m.suffix <= 20000 AND l.key >= m.start AND l.key < m.stop AND l.day < m.suffix)""",
)
def rangekey_mask(spark: SparkSession, d: str) -> DataFrame:
    points = oplog(spark, d).withColumn("suffix", F.col("day"))
    return view.masked(points, range_keys(spark, d), 20000).select("key", "seq", "day")


@query("span_truncate", f"WITH {MARKS} SELECT greatest(start, 30) AS start, least(stop, 90) AS stop, seq FROM marks WHERE greatest(start, 30) < least(stop, 90)")
def span_truncate(spark: SparkSession, d: str) -> DataFrame:
    return spans.truncate(range_keys(spark, d), 30, 90).select("start", "stop", "seq")


@query("span_overlap", f"WITH {MARKS} SELECT start, stop, seq FROM marks WHERE start < 50 AND stop > 40")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    return spans.overlapping(range_keys(spark, d), 40, 50).select("start", "stop", "seq")


def fold_sql(src: str) -> str:
    """What the rules leave of each key and stripe of src (newest entry: i = least), one entry each."""
    return f"""g AS (SELECT *, first_value(kind) OVER w AS top, first_value(val) OVER w AS top_val, max(seq) OVER p AS top_seq,
  max(CASE WHEN kind <> 'MERGE' THEN seq END) OVER p AS bar, max(CASE WHEN kind IN ('DEL', 'SINGLEDEL') THEN 1 ELSE 0 END) OVER p AS gone
  FROM {src} WINDOW p AS (PARTITION BY key, stripe), w AS (PARTITION BY key, stripe ORDER BY seq DESC)),
folded AS (SELECT key, stripe, any_value(top_seq) AS seq,
  CASE any_value(top) WHEN 'MERGE' THEN CASE WHEN any_value(bar) IS NULL THEN 'MERGE' WHEN max(CASE WHEN seq = bar THEN kind END) = 'SET' THEN 'SET' ELSE 'SETWITHDEL' END
    WHEN 'SET' THEN CASE WHEN any_value(gone) = 1 THEN 'SETWITHDEL' ELSE 'SET' END ELSE any_value(top) END AS kind,
  CAST(CASE any_value(top) WHEN 'MERGE' THEN sum(CASE WHEN seq >= coalesce(bar, -1) AND kind IN ('SET', 'MERGE') THEN val END) WHEN 'SET' THEN any_value(top_val) END AS BIGINT) AS val
  FROM g GROUP BY key, stripe)"""


@query("compaction_stripes", f"WITH {LOG}, s AS (SELECT *, {STRIPE} FROM log), {fold_sql('s')} SELECT key, stripe, seq, kind, val FROM folded")
def compaction_stripes(spark: SparkSession, d: str) -> DataFrame:
    log = oplog(spark, d)
    return maintain.compact(log, stripes(log))


@query(
    "compaction_bottom",
    f"""WITH {LOG}, {DELS}, s AS (SELECT l.*, {STRIPE} FROM log l), ds AS (SELECT *, {STRIPE} FROM dels),
left_ AS (SELECT * FROM s l WHERE NOT EXISTS (SELECT 1 FROM ds d WHERE d.stripe = l.stripe AND l.key >= d.start AND l.key < d.stop AND d.seq > l.seq)), {fold_sql('left_')}
SELECT key, stripe, seq, CASE WHEN stripe = 0 AND kind IN ('MERGE', 'SETWITHDEL') THEN 'SET' ELSE kind END AS kind, val FROM folded WHERE NOT (stripe = 0 AND kind = 'DEL')""",
)
def compaction_bottom(spark: SparkSession, d: str) -> DataFrame:
    """A compaction to the bottom level, with range deletions."""
    log = oplog(spark, d)
    return maintain.compact(log, stripes(log), True, range_deletions(spark, d))


@query("compaction_rangedel", f"WITH {LOG}, {DELS}, {cut_sql('dels', 'm.seq')}, s AS (SELECT *, {STRIPE} FROM frags) SELECT start, stop, stripe, max(seq) AS seq FROM s WHERE stripe <> 0 GROUP BY ALL")
def compaction_rangedel(spark: SparkSession, d: str) -> DataFrame:
    """Range deletions after a compaction to the bottom: fragments, the newest of each stripe but the oldest."""
    return maintain.compact_deletions(range_deletions(spark, d), stripes(oplog(spark, d)), True)


@query(
    "tombstone_elision",
    f"""WITH {LOG}, in_use AS (SELECT key // 32 AS f, min(key) AS lo, max(key) AS hi FROM log WHERE seq < {at_sql(1)} AND key % 64 < 48 GROUP BY 1)
SELECT key, seq, kind FROM log a WHERE seq >= {at_sql(1)} AND (kind <> 'DEL' OR EXISTS (SELECT 1 FROM in_use WHERE a.key BETWEEN lo AND hi))""",
)
def tombstone_elision(spark: SparkSession, d: str) -> DataFrame:
    """Deletions stay only where a file of the lower level may hold their key."""
    log = oplog(spark, d)
    low = log.where((F.col("seq") < at(log, 1)) & (F.col("key") % 64 < 48)).groupBy(F.expr("key div 32")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return maintain.elide_tombstones(log.where(F.col("seq") >= at(log, 1)), low.select("lo", "hi")).select("key", "seq", "kind")


@query(
    "ingest_merge",
    f"""WITH {LOG}, rows_ AS (SELECT o_custkey AS key, o_custkey // 500 AS f, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS val FROM orders GROUP BY ALL),
fs AS (SELECT f, (SELECT max(seq) FROM log) + row_number() OVER (ORDER BY min(key), f) AS seq FROM rows_ GROUP BY f),
u AS (SELECT key, seq, kind, val FROM log UNION ALL SELECT key, seq, 'SET', val FROM rows_ JOIN fs USING (f)), {resolved("u", None)} SELECT key, val, seq FROM resolved""",
)
def ingest_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("f", F.expr("o_custkey div 500"))
    rows = o.groupBy(F.col("o_custkey").alias("key"), "f").agg(F.max(F.round(F.col("o_totalprice") * 100).cast("long")).alias("val"))
    log = oplog(spark, d)
    return view.resolve(maintain.ingest(log, rows, "f", write.next_number(log))).select("key", "val", "seq")


@query("ingest_overlap_check", f"WITH {FILES} SELECT count(*) AS n FROM (SELECT *, lag(largest) OVER (ORDER BY smallest, file_id) AS before FROM files) WHERE before >= smallest")
def ingest_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    return maintain.ingest_overlaps(files(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("excise", f"WITH {LOG}, e AS (SELECT * FROM log WHERE key < 40 OR key >= 80), {resolved('e', None)} SELECT key, val FROM resolved")
def excise(spark: SparkSession, d: str) -> DataFrame:
    return view.resolve(maintain.excise(oplog(spark, d), 40, 80)).select("key", "val")


@query("excise_spans", f"WITH {MARKS} SELECT start, least(stop, 40) AS stop, seq FROM marks WHERE start < least(stop, 40) UNION ALL SELECT greatest(start, 80), stop, seq FROM marks WHERE greatest(start, 80) < stop")
def excise_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.excise(range_keys(spark, d), 40, 80).select("start", "stop", "seq")


@query("blob_live_values", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def blob_live_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("suffix_rewrite", "SELECT conv_id || '@' || 99 AS key, conv_id AS prefix, 99 AS suffix FROM conversations")
def suffix_rewrite(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    key = F.concat(keys.prefix(F.concat_ws("@", "conv_id", "turn")), F.lit("@99"))
    return c.select(key.alias("key"), keys.prefix(key).cast("long").alias("prefix"), keys.suffix(key).cast("int").alias("suffix"))


@query("scan_statistics", f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) SELECT kind, count(*) AS n, count(*) FILTER (r = 1) AS newest, count(*) FILTER (r > 1) AS pinned FROM r GROUP BY ROLLUP (kind)")
def scan_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.scan_statistics(oplog(spark, d))


@query("level_metrics", f"WITH {FILES} SELECT level, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(entries) AS BIGINT) AS entries FROM files GROUP BY ROLLUP (level)")
def level_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.level_metrics(files(spark, d))


@query("read_amp", "WITH e AS (SELECT event_id AS edge, 1 AS d FROM events UNION ALL SELECT event_id + 50 + user_id + 1, -1 FROM events), g AS (SELECT edge, sum(d) AS d FROM e GROUP BY edge) SELECT CAST(max(depth) AS BIGINT) AS depth FROM (SELECT sum(d) OVER (ORDER BY edge) AS depth FROM g)")
def read_amp(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return stats.stabbing_depth(e.select(F.col("event_id").alias("smallest"), (F.col("event_id") + 50 + F.col("user_id")).alias("largest")))


@query("check_levels", f"WITH {LOG}, l AS (SELECT key, seq, seq % 3 AS level FROM log), a AS (SELECT *, min(seq) OVER (PARTITION BY key ORDER BY level, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM l) SELECT count(*) AS n FROM a WHERE seq > above")
def check_levels(spark: SparkSession, d: str) -> DataFrame:
    return stats.level_violations(oplog(spark, d).withColumn("level", F.col("seq") % 3)).agg(F.count(F.lit(1)).alias("n"))


@query("find_key", f"WITH {LOG}, {DELS} SELECT 'point' AS found, seq FROM log WHERE key = 42 UNION ALL SELECT 'rangedel', seq FROM dels WHERE start <= 42 AND stop > 42")
def find_key(spark: SparkSession, d: str) -> DataFrame:
    points = oplog(spark, d).where("key = 42").select(F.lit("point").alias("found"), "seq")
    return points.union(range_deletions(spark, d).where("start <= 42 and stop > 42").select(F.lit("rangedel").alias("found"), "seq"))


@query(
    "ingest_and_excise",
    f"""WITH {LOG}, u AS (SELECT key, seq, kind, val FROM log WHERE key < 40 OR key >= 80
UNION ALL SELECT o_custkey, (SELECT max(seq) + 1 FROM log), 'SET', max(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders WHERE o_custkey >= 40 AND o_custkey < 80 GROUP BY o_custkey), {resolved("u", None)} SELECT key, val FROM resolved""",
)
def ingest_and_excise(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_custkey >= 40 and o_custkey < 80")
    rows = o.groupBy(F.col("o_custkey").alias("key")).agg(F.max(F.round(F.col("o_totalprice") * 100).cast("long")).alias("val")).withColumn("f", F.lit(1))
    log = oplog(spark, d)
    return view.resolve(maintain.ingest(maintain.excise(log, 40, 80), rows, "f", write.next_number(log))).select("key", "val")


@query("disk_usage_by_placement", f"WITH {FILES} SELECT CASE WHEN level < 3 THEN 'local' WHEN level < 6 THEN 'shared' ELSE 'external' END AS placement, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes FROM files GROUP BY 1")
def disk_usage_by_placement(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("level") < 3, "local").when(F.col("level") < 6, "shared").otherwise("external")
    return files(spark, d).groupBy(place.alias("placement")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))


@query("protected_ranges_read", f"WITH {LOG}, k AS (SELECT * FROM log WHERE seq < {at_sql(5)} AND (key BETWEEN 5 AND 14 OR key BETWEEN 70 AND 89)), {resolved('k', None)} SELECT key, val FROM resolved")
def protected_ranges_read(spark: SparkSession, d: str) -> DataFrame:
    log = oplog(spark, d)
    return view.resolve(log.where("key between 5 and 14 or key between 70 and 89"), None, at(log, 5)).select("key", "val")


@query("durable_read", f"WITH {LOG}, k AS (SELECT * FROM log WHERE seq < (SELECT max(seq) // 2 FROM log)), {resolved('k', None)} SELECT key, n FROM resolved")
def durable_read(spark: SparkSession, d: str) -> DataFrame:
    log = oplog(spark, d)
    flushed = log.agg(F.expr("max(seq) div 2")).scalar()
    return view.resolve(log, None, flushed).select("key", "n")


@query("skip_point_filter", f"WITH {LOG}, k AS (SELECT * FROM log WHERE key % 4 <> 1), {resolved('k', None)} SELECT key, val FROM resolved")
def skip_point_filter(spark: SparkSession, d: str) -> DataFrame:
    return view.resolve(oplog(spark, d).where("key % 4 != 1")).select("key", "val")


@query("overwrite_merge", f"WITH {LOG} SELECT key, seq, val FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND kind <> 'DEL'")
def overwrite_merge(spark: SparkSession, d: str) -> DataFrame:
    return view.overwritten(oplog(spark, d)).select("key", "seq", "val")


SINGLES = f"""singles AS (SELECT key, seq, val, CASE WHEN kind = 'DEL' AND seq % 3 <> 0 THEN 'SINGLEDEL' ELSE kind END AS kind, {STRIPE} FROM log),
e AS (SELECT *, row_number() OVER (PARTITION BY key, stripe ORDER BY seq DESC) AS i FROM singles)"""


def _singles(log: DataFrame) -> DataFrame:
    return log.withColumn("kind", F.when((F.col("kind") == "DEL") & (F.col("seq") % 3 != 0), "SINGLEDEL").otherwise(F.col("kind")))


@query(
    "single_delete",
    f"""WITH RECURSIVE {LOG}, {SINGLES},
m AS (SELECT DISTINCT key, stripe, CAST(0 AS BIGINT) AS i, 'free' AS state, CAST(NULL AS BIGINT) AS pending FROM e
  UNION ALL SELECT e.key, e.stripe, e.i,
    CASE WHEN e.kind = 'SINGLEDEL' THEN 'single' WHEN m.state = 'single' AND e.kind IN ('SET', 'MERGE') THEN 'free' WHEN m.state = 'single' THEN 'del' ELSE 'live' END,
    CASE WHEN m.state = 'free' AND e.kind = 'SINGLEDEL' THEN e.seq ELSE m.pending END
  FROM m JOIN e ON e.key = m.key AND e.stripe = m.stripe AND e.i = m.i + 1 WHERE m.state IN ('free', 'single')),
done AS (SELECT key, stripe, max(i) AS i, arg_max(state, i) AS state, arg_max(pending, i) AS pending FROM m GROUP BY key, stripe),
live AS (SELECT e.* FROM e JOIN done d ON d.key = e.key AND d.stripe = e.stripe AND d.state = 'live' AND e.i >= d.i), {fold_sql('live')}
SELECT key, stripe, seq, kind, val FROM folded
UNION ALL SELECT key, stripe, pending, CASE state WHEN 'del' THEN 'DEL' ELSE 'SINGLEDEL' END, NULL FROM done WHERE state IN ('single', 'del')""",
)
def single_delete(spark: SparkSession, d: str) -> DataFrame:
    """A compaction of a log in which two of three deletions are SINGLEDELs."""
    log = oplog(spark, d)
    return maintain.compact(_singles(log), stripes(log))


@query(
    "deterministic_single_delete",
    f"""WITH {LOG}, {SINGLES}, k AS (SELECT *, max(seq) OVER p AS top, arg_max(kind, seq) OVER p AS top_kind, lag(kind) OVER (PARTITION BY key ORDER BY seq DESC) AS above FROM singles WINDOW p AS (PARTITION BY key)),
d AS (SELECT *, coalesce(max(CASE WHEN kind = 'DEL' THEN seq END) OVER (PARTITION BY key), -1) AS del FROM k)
SELECT key, any_value(top) AS seq, NOT bool_or(seq < top AND seq > del AND kind IN ('SET', 'MERGE') AND above <> 'SINGLEDEL') AS same FROM d WHERE top_kind IN ('SET', 'MERGE') GROUP BY key""",
)
def deterministic_single_delete(spark: SparkSession, d: str) -> DataFrame:
    """Per key that exists, whether a SINGLEDEL would delete it as surely as a DEL."""
    return maintain.deterministic(_singles(oplog(spark, d)))


@query("manifest_current_files", "WITH e AS (SELECT o_orderkey % 500 AS file_id, o_orderkey AS edit_no, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'add' END AS action FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY edit_no DESC, action) AS r FROM e) SELECT file_id, edit_no FROM l WHERE r = 1 AND action = 'add'")
def manifest_current_files(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("add")
    edits = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("file_id"), F.col("o_orderkey").alias("edit_no"), action.alias("action"))
    return view.newest(edits, ["file_id"], [F.col("edit_no"), F.col("action") == "add"]).where("action = 'add'").select("file_id", "edit_no")
