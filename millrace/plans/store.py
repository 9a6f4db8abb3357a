"""Queries about writes, files, edits and keys of a store, and the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators import maintain, spans, stats, view, write
from millrace.operators.deal import nearest, ranked
from millrace.plans.catalogue import COAL, DELS, FILES, FRAGS, LOG, MARKS, STRIPE, at, at_sql, query, resolved, stripes
from millrace.sources.tables import files, oplog, range_deletions, range_keys, separate, table

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
#: Files with the newest number of their entries, and range deletions over their keys.
AGED = f"""aged AS (SELECT o_orderkey // 100 AS file_id, min(o_orderkey) AS smallest, max(o_orderkey) AS largest, max(o_custkey) AS max_seq,
  CAST(sum({CENTS}) AS BIGINT) AS bytes FROM orders GROUP BY 1)"""
WIDE = "wide AS (SELECT s_suppkey * 130 AS start, s_suppkey * 130 + 260 AS stop, s_suppkey * 40 AS seq FROM supplier)"


def _cents() -> F.Column:
    return F.round(F.col("o_totalprice") * 100).cast("long")


def _aged(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.expr("o_orderkey div 100").alias("file_id")).agg(
        F.min("o_orderkey").alias("smallest"), F.max("o_orderkey").alias("largest"), F.max("o_custkey").alias("max_seq"), F.sum(_cents()).alias("bytes")
    )


def _wide(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select((k * 130).alias("start"), (k * 130 + 260).alias("stop"), (k * 40).alias("seq"))


@query(
    "apply_batch",
    f"""WITH {LOG}, b AS (SELECT o_custkey AS key, (SELECT max(seq) + 1 FROM log) + o_orderkey AS seq,
CASE o_orderstatus WHEN 'F' THEN 'DEL' WHEN 'O' THEN 'SET' ELSE 'MERGE' END AS kind, {CENTS} AS val FROM orders),
u AS (SELECT key, seq, kind, val FROM log UNION ALL SELECT * FROM b), {resolved("u", None)} SELECT key, val, n, seq FROM resolved""",
)
def apply_batch(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "DEL").when(F.col("o_orderstatus") == "O", "SET").otherwise("MERGE")
    batch = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ordinal"), kind.alias("kind"), _cents().alias("val"))
    log = oplog(spark, d).select("key", "seq", "kind", "val")
    return view.resolve(log.unionByName(write.numbered(batch, write.next_number(log)))).select("key", "val", "n", "seq")


@query(
    "join_batches",
    f"""WITH b AS (SELECT o_custkey AS key, o_orderkey AS seq, 'SET' AS kind, {CENTS} AS val FROM orders
UNION ALL SELECT c_custkey, (SELECT count(*) FROM orders) + c_custkey, 'MERGE', CAST(round(c_acctbal * 100) AS BIGINT) FROM customer), {resolved("b", None)} SELECT key, val, seq FROM resolved""",
)
def join_batches(spark: SparkSession, d: str) -> DataFrame:
    """A second batch applied to a first: its ordinals start where the first ends."""
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ordinal"), F.lit("SET").alias("kind"), _cents().alias("val"))
    second = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("ordinal"), F.lit("MERGE").alias("kind"), F.round(F.col("c_acctbal") * 100).cast("long").alias("val"))
    return view.resolve(write.numbered(write.joined([first, second]), 0)).select("key", "val", "seq")


@query("wide_tombstones", f"WITH {AGED}, {WIDE} SELECT file_id, bytes FROM aged a WHERE EXISTS (SELECT 1 FROM wide w WHERE w.start <= a.smallest AND a.largest < w.stop AND a.max_seq < w.seq)")
def wide_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Files that a newer range deletion holds whole: they can be dropped unread."""
    return maintain.wholly_deleted(_aged(spark, d), _wide(spark, d)).select("file_id", "bytes")


@query(
    "ingest_target_level",
    f"""WITH {FILES}, n AS (SELECT s_suppkey AS id, s_suppkey * 150 AS lo, s_suppkey * 150 + 40 AS hi FROM supplier)
SELECT id, CASE WHEN min(level) IS NULL THEN 6 ELSE greatest(min(level) - 1, 0) END AS target FROM n LEFT JOIN files f ON f.smallest <= hi AND f.largest >= lo GROUP BY id""",
)
def ingest_target_level(spark: SparkSession, d: str) -> DataFrame:
    """The lowest level that a file can go to: above the first level that overlaps it."""
    k = F.col("s_suppkey")
    new = table(spark, d, "supplier").select(k.alias("id"), (k * 150).alias("lo"), (k * 150 + 40).alias("hi"))
    return maintain.target_level(new, files(spark, d), 6)


@query("external_rewrite", "SELECT 'T' || c_custkey || '@' || 7 AS key, 'T' || c_custkey AS prefix, 7 AS suffix FROM customer WHERE c_custkey >= 20 AND c_custkey < 900")
def external_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """External files under virtual bounds, with a synthetic prefix and suffix."""
    key = F.concat(F.lit("T"), F.col("c_custkey").cast("string"), F.lit("@7"))
    c = table(spark, d, "customer").where("c_custkey >= 20 and c_custkey < 900").select(key.alias("key"))
    return c.select("key", keys.prefix(F.col("key")).alias("prefix"), keys.suffix(F.col("key")).cast("int").alias("suffix"))


@query("checkpoint_span", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey // 100 IN (SELECT o_orderkey // 100 FROM orders GROUP BY 1 HAVING min(o_orderkey) <= 780 AND max(o_orderkey) >= 420)")
def checkpoint_span(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint of a span keeps whole files that overlap it."""
    hit = files(spark, d).where("smallest <= 780 and largest >= 420").select("file_id")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.expr("o_orderkey div 100").alias("file_id"))
    return o.join(hit, "file_id", "left_semi").select("key")


@query("change_feed", f"WITH {LOG}, f AS (SELECT key, seq, kind, val FROM log WHERE key >= 30 AND key < 60 AND seq < {at_sql(7)}), t AS (SELECT key, seq, kind, val FROM log WHERE (key < 30 OR key >= 60) AND seq < {at_sql(2)} UNION ALL SELECT * FROM f), {resolved('t', None)} SELECT key, val FROM resolved")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """A span of one store's entries put in place of another's."""
    log = oplog(spark, d).select("key", "seq", "kind", "val")
    feed = view.visible(log, at(log, 7)).where("key >= 30 and key < 60")
    return view.resolve(maintain.excise(view.visible(log, at(log, 2)), 30, 60).unionByName(feed)).select("key", "val")


@query("separated_values", "SELECT doc_id, source, CASE WHEN length(text) >= 500 THEN 'blob' ELSE 'inline' END AS place, CASE WHEN length(text) < 500 THEN text END AS inline, length(text) AS size FROM documents WHERE text IS NOT NULL")
def separated_values(spark: SparkSession, d: str) -> DataFrame:
    """Large values live apart: what a row keeps of each, by one look at it."""
    return separate(table(spark, d, "documents").where("text is not null"), "text", 500).select("doc_id", "source", "place", "inline", "size")


@query("rangekey_compaction", f"""WITH {LOG}, {MARKS}, {FRAGS}, st AS (SELECT *, {STRIPE} FROM frags),
dead AS (SELECT *, coalesce(max(CASE WHEN kind = 'DEL' THEN seq END) OVER (PARTITION BY start, stop, stripe), -1) AS dead FROM st),
r AS (SELECT *, row_number() OVER (PARTITION BY start, stop, stripe, kind = 'DEL', CASE WHEN kind = 'DEL' THEN 0 ELSE suffix END ORDER BY seq DESC, CASE WHEN kind = 'SET' THEN 0 ELSE 1 END, val DESC) AS r FROM dead WHERE seq >= dead)
SELECT start, stop, stripe, kind, CASE WHEN kind <> 'DEL' THEN suffix END AS suffix, seq FROM r WHERE r = 1 AND NOT (stripe = 0 AND kind <> 'SET')""")  # fmt: skip
def rangekey_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Range keys coalesced within each stripe; nothing lies beneath the last one, so only SETs stay there."""
    return maintain.compact_range_keys(spans.fragments(range_keys(spark, d)), stripes(oplog(spark, d))).select("start", "stop", "stripe", "kind", "suffix", "seq")


@query("defragment_internal", f"""WITH {MARKS}, {FRAGS}, p AS (SELECT *, CASE WHEN lag(stop) OVER w = start THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT * FROM frags) WINDOW w AS (PARTITION BY seq, kind, suffix, val ORDER BY start)),
n AS (SELECT *, sum(new) OVER (PARTITION BY seq, kind, suffix, val ORDER BY start) AS run FROM p) SELECT seq, kind, suffix, val, min(start) AS start, max(stop) AS stop FROM n GROUP BY seq, kind, suffix, val, run""")  # fmt: skip
def defragment_internal(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that abut and are equal to the trailer become one."""
    return spans.join_abutting(spans.fragments(range_keys(spark, d)).distinct(), ["seq", "kind", "suffix", "val"])


@query("span_at_or_before", f"WITH {MARKS}, p AS (SELECT DISTINCT l_suppkey * 3 AS probe FROM lineitem) SELECT probe, (SELECT max(start) FROM marks WHERE start <= probe) AS start FROM p")
def span_at_or_before(spark: SparkSession, d: str) -> DataFrame:
    """Per probe the start of the last span that starts at it or before."""
    probes = table(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("key")).distinct()
    return nearest(range_keys(spark, d).select(F.col("start").alias("key"), "start").distinct(), probes, "key", ["start"]).withColumnRenamed("key", "probe")


@query("range_key_changed", f"""WITH {LOG}, {MARKS}, {FRAGS}, {COAL}, sp AS (SELECT start, stop, count(*) AS n_keys FROM coal GROUP BY ALL), k AS (SELECT DISTINCT key FROM log)
SELECT key, n_keys, start IS DISTINCT FROM lag(start) OVER w OR lag(key) OVER w IS NULL AS changed FROM k LEFT JOIN sp ON key >= start AND key < stop WINDOW w AS (ORDER BY key)""")  # fmt: skip
def range_key_changed(spark: SparkSession, d: str) -> DataFrame:
    """The range keys over each point, and whether they differ from those of the point before."""
    sp = spans.coalesce(spans.fragments(range_keys(spark, d))).groupBy("start", "stop").agg(F.count(F.lit(1)).alias("n_keys"))
    k = oplog(spark, d).select("key").distinct()
    rows = ranked(k.join(spans.covering(k, sp, True).drop("stop"), "key", "left"), "key", "n")
    past = rows.select((F.col("n") + 1).alias("n"), F.col("start").alias("_past"))
    return rows.join(past, "n", "left").select("key", "n_keys", ((F.col("n") == 0) | ~F.col("start").eqNullSafe(F.col("_past"))).alias("changed"))


@query("files_listing", f"WITH {FILES} SELECT file_id, level, smallest, largest, CASE WHEN smallest >= 300 AND largest <= 2000 THEN bytes ELSE bytes * (least(largest, 2000) - greatest(smallest, 300) + 1) // (largest - smallest + 1) END AS span_bytes FROM files WHERE smallest <= 2000 AND largest >= 300")
def files_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files in a key range with the bytes they hold in it; a cut file counts by its share of keys."""
    return stats.span_bytes(files(spark, d), 300, 2000).select("file_id", "level", "smallest", "largest", "span_bytes")


@query("count_and_size_by_placement", f"WITH {FILES} SELECT level, count(*) FILTER (file_id % 3 = 0) AS local_n, CAST(coalesce(sum(bytes) FILTER (file_id % 3 = 0), 0) AS BIGINT) AS local_bytes, count(*) FILTER (file_id % 3 <> 0) AS shared_n, CAST(coalesce(sum(bytes) FILTER (file_id % 3 <> 0), 0) AS BIGINT) AS shared_bytes FROM files GROUP BY level")
def count_and_size_by_placement(spark: SparkSession, d: str) -> DataFrame:
    local = F.col("file_id") % 3 == 0
    each = lambda name, on: (F.count_if(on).alias(f"{name}_n"), F.coalesce(F.sum(F.when(on, F.col("bytes"))), F.lit(0)).alias(f"{name}_bytes"))
    return files(spark, d).groupBy("level").agg(*each("local", local), *each("shared", ~local))


@query("log_dump", f"WITH {LOG} SELECT seq // 64 AS batch, min(seq) AS first_seq, count(*) AS n, string_agg(kind || ':' || key, ' ' ORDER BY seq) AS ops FROM log GROUP BY 1")
def log_dump(spark: SparkSession, d: str) -> DataFrame:
    """A log's batches with their operations in order."""
    ops = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "key"))), lambda x: F.concat(x["kind"], F.lit(":"), x["key"].cast("string")))
    return oplog(spark, d).groupBy(F.expr("seq div 64").alias("batch")).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"), F.array_join(ops, " ").alias("ops"))


@query("sorted_check", "WITH o AS (SELECT l_suppkey AS file_id, l_orderkey AS key, lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS before FROM lineitem) SELECT file_id, count(*) AS n, count(*) FILTER (before > key) AS unsorted FROM o GROUP BY file_id")
def sorted_check(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each file that stand after a larger key."""
    return stats.order_violations(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "file_id").withColumnRenamed("l_orderkey", "key"), "file_id", "key", ["l_shipdate", "key", "l_linenumber"])


@query("key_encodings", """SELECT doc_id, rpad(hex(encode(substr(source, 1, 8))), 16, '0') AS short, doc_id * 256 + 1 AS trailer, doc_id AS seq, CAST(1 AS BIGINT) AS kind, hex(encode(source)) || '00' AS successor FROM documents WHERE source IS NOT NULL""")
def key_encodings(spark: SparkSession, d: str) -> DataFrame:
    s, t = F.encode("source", "UTF-8"), keys.trailer(F.col("doc_id"), F.lit(1).cast("long"))
    return table(spark, d, "documents").where("source is not null").select(
        "doc_id", keys.abbreviated(s).alias("short"), t.alias("trailer"), keys.trailer_seq(t).alias("seq"), keys.trailer_kind(t).alias("kind"), F.hex(keys.immediate_successor(s)).alias("successor")
    )


@query("deletion_coverage", f"WITH {LOG}, {DELS} SELECT d.start, d.seq, count(*) AS n, CAST(sum(l.val) AS BIGINT) AS bytes FROM dels d JOIN log l ON l.key >= d.start AND l.key < d.stop AND l.seq < d.seq GROUP BY ALL")
def deletion_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What each range deletion shadows."""
    hit = spans.covering(oplog(spark, d).withColumnRenamed("seq", "own"), range_deletions(spark, d)).where("own < seq")
    return hit.groupBy("start", "seq").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("bytes"))


@query("steps", f"WITH {LOG}, k AS (SELECT DISTINCT key FROM log) SELECT key, lag(key) OVER w AS previous, lead(key) OVER w AS next FROM k WINDOW w AS (ORDER BY key)")
def steps(spark: SparkSession, d: str) -> DataFrame:
    """Each key with its neighbours."""
    return view.steps(oplog(spark, d).select("key"))


@query("seek_with_limit", """WITH probes AS (SELECT DISTINCT l_partkey * 3 AS probe, l_partkey * 3 + 4 AS lim FROM lineitem), ks AS (SELECT DISTINCT o_orderkey * 7 AS key FROM orders),
f AS (SELECT probe, lim, min(key) AS found FROM probes LEFT JOIN ks ON key >= probe GROUP BY ALL) SELECT probe, CASE WHEN found < lim THEN found END AS found, coalesce(found >= lim, FALSE) AS at_limit FROM f""")  # fmt: skip
def seek_with_limit(spark: SparkSession, d: str) -> DataFrame:
    """Seeks that stop at a limit: a key past it isn't given, but the position isn't exhausted."""
    probes = table(spark, d, "lineitem").select((F.col("l_partkey") * 3).alias("probe"), (F.col("l_partkey") * 3 + 4).alias("lim")).distinct()
    return view.seek(table(spark, d, "orders").select((F.col("o_orderkey") * 7).alias("key")), probes, True, "lim").drop("lim")


@query("seek_binary", """WITH k AS (SELECT DISTINCT encode(coalesce(source, '')) AS key FROM documents), p AS (SELECT DISTINCT encode(role) AS probe FROM conversations WHERE role IS NOT NULL)
SELECT hex(probe) AS probe, hex(min(key)) AS found FROM p LEFT JOIN k ON key >= probe GROUP BY probe""")  # fmt: skip
def seek_binary(spark: SparkSession, d: str) -> DataFrame:
    """Seeks over binary keys in byte order."""
    k = table(spark, d, "documents").select(F.encode(F.coalesce("source", F.lit("")), "UTF-8").alias("key"))
    probes = table(spark, d, "conversations").where("role is not null").select(F.encode("role", "UTF-8").alias("probe")).distinct()
    return view.seek(k, probes, True).select(F.hex("probe").alias("probe"), F.hex("found").alias("found"))


@query("engine_keys", "SELECT user_id, hex(encode(event_type)) || '00' || lpad(hex(epoch_us(ts) * 1000), 16, '0') || CASE WHEN event_id % 2 = 1 THEN lpad(hex(event_id), 8, '0') || '0D' ELSE '09' END AS key, event_type AS prefix, epoch_us(ts) * 1000 AS wall, CASE WHEN event_id % 2 = 1 THEN event_id ELSE 0 END AS logical FROM events")
def engine_keys(spark: SparkSession, d: str) -> DataFrame:
    """Versioned keys written in their engine form, and read back."""
    logical = F.when(F.col("event_id") % 2 == 1, F.col("event_id"))
    key = keys.engine_key(F.encode("event_type", "UTF-8"), F.unix_micros(F.col("ts").cast("timestamp")) * 1000, logical)
    rows = table(spark, d, "events").select("user_id", key.alias("key"))
    return rows.select("user_id", F.hex("key").alias("key"), F.decode(keys.engine_prefix("key"), "UTF-8").alias("prefix"), keys.engine_wall("key").alias("wall"), keys.engine_logical("key").alias("logical"))


@query("batch_summary", "SELECT count(*) FILTER (event_type <> 'view') AS n, count(*) FILTER (event_type = 'view') AS n_log, count(*) = 0 AS empty FROM events")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "LOGDATA").otherwise("SET")
    return write.batch_summary(table(spark, d, "events").select(kind.alias("kind"), F.col("event_id").alias("ordinal"))).drop("kinds")


@query("foreign_range_keys", f"WITH {MARKS}, {FRAGS}, {COAL} SELECT start, stop, suffix, val, CAST(77 AS BIGINT) AS seq FROM coal")
def foreign_range_keys(spark: SparkSession, d: str) -> DataFrame:
    """Range keys of another store's file, all at one number."""
    return spans.foreign(range_keys(spark, d), 77).select("start", "stop", "suffix", "val", "seq")


@query("span_filter", f"WITH {MARKS} SELECT start * 2 AS start, stop * 2 AS stop, seq FROM marks WHERE kind = 'SET'")
def span_filter(spark: SparkSession, d: str) -> DataFrame:
    """Spans filtered by their operations and mapped to other bounds."""
    kept = spans.keep(range_keys(spark, d), F.col("kind") == "SET")
    return spans.transform(kept, lambda x: x.withColumns({"start": F.col("start") * 2, "stop": F.col("stop") * 2})).select("start", "stop", "seq")
