"""Writes, file maintenance and log parsing on small golden cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators import maintain, spans, stats, write
from millrace.sources.tables import block_intervals, matching_files, read_store, write_store

FILE = "file_id long, smallest long, largest long, max_seq long, bytes long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_batches(spark):
    a, b = (spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "key string, ordinal long") for ks in ("xy", "z"))
    assert rows(write.numbered(write.joined([a, b]), 20), "key", "seq") == [("x", 20), ("y", 21), ("z", 22)]
    assert spark.range(1).select(write.next_number(spark.createDataFrame([], "seq long"))).first()[0] == 10
    got = write.batch_summary(spark.createDataFrame([("SET", 0), ("LOGDATA", 1)], "kind string, ordinal long")).first()
    assert (got["n"], got["n_log"], got["empty"]) == (1, 1, False)


def test_wide_tombstones(spark):
    f = spark.createDataFrame([(1, 5, 250, 7, 10), (2, 300, 310, 7, 20), (3, 400, 401, 9, 30)], FILE)
    d = spark.createDataFrame([(0, 311, 8), (390, 500, 9)], "start long, stop long, seq long")
    assert rows(maintain.wholly_deleted(f, d), "file_id") == [(1,), (2,)]
    assert rows(maintain.beneath(f, d), "file_id", "start") == [(1, 0), (2, 0)]


def test_target_level(spark):
    f = spark.createDataFrame([(1, 0, 9, 0), (2, 20, 29, 3)], "file_id long, smallest long, largest long, level long")
    n = spark.createDataFrame([(1, 5, 6), (2, 21, 22), (3, 40, 50)], "id long, lo long, hi long")
    assert rows(maintain.target_level(n, f, 6), "id", "target") == [(1, 0), (2, 2), (3, 6)]


def test_join_abutting(spark):
    f = spark.createDataFrame([(0, 2, 7), (2, 4, 7), (5, 6, 7), (4, 5, 8)], "start long, stop long, seq long")
    assert rows(spans.join_abutting(f, ["seq"]), "start", "stop") == [(0, 4), (4, 5), (5, 6)]


#: Lines as a store writes them.
LINES = [
    "I211215 14:26:56.012382 51831533 3@store/compaction.go:1845 \u22ee [n5,kv,s5] 1216510  [JOB 284925] compacting(default) L2 [442555] (4.2 M) + L3 [445853] (8.4 M)",
    "I211215 14:26:56.318543 51831533 3@store/compaction.go:1886 \u22ee [n5,kv,s5] 1216554  [JOB 284925] compacted(default) L2 [442555] (4.2 M) + L3 [445853] (8.4 M) -> L3 [445883 445887] (13 M), in 0.3s, output rate 42 M/s",
    "I211215 14:27:00.000000 51831533 3@store/compaction.go:1845 \u22ee [T1,n5,kv,s5] 1216510  [JOB 7] compacting(move) L2 [1] (1.5KB) + L3 [] (0B)",
    "I211213 16:23:48.903751 21136 3@store/event.go:599 \u22ee [n9,kv,s9] 24 [JOB 10] flushing 2 memtables (1.4MB)  to L0",
    "I211213 16:23:49.134464 21136 3@store/event.go:603 \u22ee [n9,kv,s9] 26 [JOB 10] flushed 2 memtables (1.4MB) to L0 [1535806] (1.3MB), in 0.2s, output rate 5.8MB/s",
    "I220228 16:01:22.487906 18476248525 3@store/ingest.go:637 \u22ee [n24,kv,s24] 33430782  [JOB 10211226] ingested L0:21818678 (1.8 K), L6:21818683(remote) (1.2KB)",
    "I220228 16:01:22.487906 18476248525 3@store/ingest.go:637 \u22ee [n24,kv,s24] 33430782  no job here",
]


def test_maintenance_log(spark):
    events = stats.maintenance_events(spark.createDataFrame([(x,) for x in LINES], "line string"))
    mb, kb = 1024**2, 1024
    assert rows(events.na.fill(-1), "node", "store", "job", "type", "from_level", "to_level", "bytes_in", "bytes_out") == [
        (5, 5, 284925, "default", 2, 3, round(4.2 * mb) + round(8.4 * mb), 13 * mb),
        (9, 9, 10, "flush", -1, 0, 0, round(1.3 * mb)),
        (24, 24, 10211226, "ingest", -1, 0, 0, round(1.8 * kb)),
        (24, 24, 10211226, "ingest", -1, 6, 0, round(1.2 * kb)),
    ]
    took = {r["type"]: r["took"] for r in events.selectExpr("type", "unix_micros(ended) - unix_micros(began) as took").collect()}
    assert took == {"default": 306161, "flush": 230713, "ingest": 0}
    at = lambda minute, second: datetime(2024, 1, 1, 0, minute, second)
    jobs = [(1, 1, "move", 2, 3, at(0, 1), at(2, 0), 5, 7), (1, 1, "default", 2, 3, at(10, 0), at(10, 1), 5, 7), (2, 1, "default", 2, 3, at(10, 0), at(10, 30), 5, 7)]
    e = spark.createDataFrame(jobs, "node long, store long, type string, from_level int, to_level int, began timestamp, ended timestamp, bytes_in long, bytes_out long")
    got = stats.maintenance_windows(e, 600, 30).selectExpr("node", "type", "minute(window) as m", "bytes_in", "bytes_moved", "long_running")
    assert rows(got, "node", "type", "m", "bytes_in", "bytes_moved", "long_running") == [(1, "default", 0, 5, 0, 0), (1, "move", 0, 0, 5, 1), (2, "default", 10, 5, 0, 0)]


def test_mid_key(spark):
    f = spark.createDataFrame([(0, 9, 100), (10, 19, 100), (20, 29, 100), (30, 39, 100)], "smallest long, largest long, bytes long")
    assert rows(stats.mid_key(f, 0, 40, 10), "mid_key", "run") == [(19, 200)]
    assert stats.mid_key(f, 0, 40, 300).count() == 0
    assert stats.mid_key(f.where("smallest = 0"), 0, 40, 10).count() == 0  # one unit passes half by too much
    with pytest.raises(ValueError):
        stats.mid_key(f, 5, 5, 1)
    with pytest.raises(ValueError):
        stats.disk_usage(f, 9, 5)


def test_scores_and_amplification(spark):
    levels = spark.createDataFrame([(0, 0, 0, 1, 20, 8), (1, 300, 0, 100, 0, 0), (2, 500, 0, 1000, 0, 0), (3, 50, 0, 10000, 0, 0)], "level int, bytes long, deletion_bytes long, target long, files long, depth long")
    got = {r["level"]: round(r["score"], 6) for r in stats.level_scores(levels).collect()}
    assert got == {0: round(4 / 3, 6), 1: 6.0, 2: 0.0, 3: 0.0}
    w = spark.createDataFrame([(0, 0, 5, 10, 0), (1, 10, 0, 0, 30)], "level int, bytes_in long, bytes_ingested long, bytes_flushed long, bytes_compacted long")
    assert {r["level"]: r["write_amp"] for r in stats.write_amplification(w, 20).collect()} == {0: 0.0, 1: 3.0, None: 65 / 25}


def test_categories_tiers_and_samples(spark):
    bounds = [(10, "a"), (20, "b"), (None, "c")]
    assert [stats.category_range(*x, bounds) for x in ((1, 5), (1, 10), (9, 25))] == ["a", "a-b", "a-c"]
    v = spark.createDataFrame([(0, 5), (None, 1), (3, 10), (9, 20)], "a int, n long")
    assert tuple(stats.tiering(v, [], "a", "n", 3).first()) == (36, 6, 10, 20)
    s = spark.createDataFrame([(0, 1), (1, 2), (90, 7), (100, 8)], "t long, v long")
    assert rows(stats.sampled(s, "t", "v", 4), "bucket", "value") == [(0, 2), (1, 8), (2, 8), (3, 8)]


def test_store_files(spark, tmp_path):
    log = spark.createDataFrame([(k, s, "SET", k * s) for k in range(50) for s in (10, 20)], "key long, seq long, kind string, val long")
    path = str(tmp_path / "store")
    write_store(log, path, parts=4)
    assert read_store(spark, path).count() == 100
    live = read_store(spark, path, obsolete=False)
    assert live.count() == 50 and live.agg({"seq": "min"}).first()[0] == 20
    assert "PartitionFilters: [isnotnull(obsolete" in live._jdf.queryExecution().toString()
    intervals = block_intervals(spark, path, ["key"])
    assert intervals.count() == 8 and 0 < matching_files(intervals, "key", 0, 5).count() < 8


def test_engine_keys(spark):
    k = spark.createDataFrame([(b"a", 5, 7), (b"a", 9, 0), (b"b", 1, None)], "p binary, wall long, logical long")
    k = k.select(keys.engine_key(F.col("p"), F.col("wall"), F.col("logical")).alias("k")).unionByName(k.where("p = X'61'").limit(1).select(keys.engine_key(F.col("p")).alias("k")))
    got = k.orderBy(*keys.engine_order("k")).select(keys.engine_prefix("k").alias("p"), keys.engine_wall("k"), keys.engine_logical("k")).collect()
    assert [(bytes(r[0]), r[1], r[2]) for r in got] == [(b"a", None, None), (b"a", 9, 0), (b"a", 5, 7), (b"b", 1, 0)]
