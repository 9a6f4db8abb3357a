"""Golden cases of the resolved view, spans and maintenance, and the view against a walk in plain Python."""

import random

import pytest

from millrace.operators import maintain, mergers, spans, stats, view

LOG = "key long, seq long, kind string, val long"
SPAN = "start long, stop long, seq long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def walk(log, dels, snapshot):
    out = {}
    for key in {r[0] for r in log}:
        mine = sorted((r for r in log if r[0] == key and r[1] < snapshot), key=lambda r: -r[1])
        mine = [r for r in mine if not any(s <= key < e and r[1] < q < snapshot for s, e, q in dels)]
        total = None
        for _, _, kind, val in mine:
            if kind == "DEL":
                break
            total = (total or 0) + val
            if kind == "SET":
                break
        if total is not None:
            out[key] = total
    return sorted(out.items())


def test_view_against_walk(spark):
    r = random.Random(4)
    log = [(r.randrange(20), s, r.choice(["SET", "MERGE", "DEL"]), r.randrange(100)) for s in range(10, 300)]
    dels = [(a := r.randrange(18), a + r.randrange(1, 6), r.randrange(10, 300)) for _ in range(8)]
    a, b = spark.createDataFrame(log, LOG), spark.createDataFrame(dels, SPAN)
    for snapshot in (10, 60, 200, 400):
        assert rows(view.resolve(a, b, snapshot), "key", "val") == walk(log, dels, snapshot)


def test_strictness(spark):
    log = spark.createDataFrame([(1, 5, "SET", 9)], LOG)
    dels = spark.createDataFrame([(0, 9, 5)], SPAN)
    assert rows(view.resolve(log, dels), "key") == [(1,)]
    assert rows(view.resolve(log, dels, 5), "key") == []


def test_merge_barriers(spark):
    log = spark.createDataFrame([(1, 9, "MERGE", 1), (1, 8, "MERGE", 2), (1, 7, "MERGE", 4), (1, 6, "SET", 8), (2, 9, "MERGE", 1), (2, 8, "DEL", 2), (2, 7, "SET", 4)], LOG)
    assert rows(view.resolve(log, trail=True), "key", "val", "trail") == [(1, 15, "8,4,2,1"), (2, 1, "1")]


def test_every_kind(spark):
    """Deletions of all kinds hide alike, SETWITHDEL reads like SET, LOGDATA not at all, in chunks of any size."""
    r = random.Random(12)
    kinds = ["SET", "MERGE", "DEL", "SINGLEDEL", "DELSIZED", "SETWITHDEL", "LOGDATA"]
    log = [(r.randrange(9), s, r.choice(kinds), r.randrange(100)) for s in range(10, 250)]
    plain = [(k, s, {"SINGLEDEL": "DEL", "DELSIZED": "DEL", "SETWITHDEL": "SET"}.get(kind, kind), v) for k, s, kind, v in log if kind != "LOGDATA"]
    for chunk in (7, 1 << 20):
        assert rows(view.resolve(spark.createDataFrame(log, LOG), chunk=chunk), "key", "val") == walk(plain, [], 10**9)


def test_binary_keys(spark):
    log = spark.createDataFrame([(b"a", 5, "SET", 1), (b"b", 6, "SET", 2), (b"c\xff", 7, "MERGE", 3)], "key binary, seq long, kind string, val long")
    dels = spark.createDataFrame([(b"a", b"b", 9), (b"c", b"c\xff", 9)], "start binary, stop binary, seq long")
    assert [bytes(r["key"]) for r in view.resolve(log, dels).orderBy("key").collect()] == [b"b", b"c\xff"]


def test_wide_spans(spark):
    """A span over 10^12 keys costs what it is cut into."""
    log = spark.createDataFrame([(k, 5, "SET", 1) for k in (0, 5, 10**11, 10**12)], LOG)
    dels = spark.createDataFrame([(1, 10**12, 9), (3, 6, 2)], SPAN)
    assert rows(view.resolve(log, dels), "key") == [(0,), (10**12,)]


def automaton(entries, snapshots, bottom):
    """What a compaction leaves, an entry at a time; entries are (seq, kind, val, size) of one key."""
    out = []
    for k in range(len(snapshots), -1, -1):
        mine = sorted((e for e in entries if sum(e[0] >= s for s in snapshots) == k and e[1] != "LOGDATA"), reverse=True)
        gone = ("DEL", "SINGLEDEL", "DELSIZED")
        i = 0
        while i < len(mine):
            seq, kind, val, size = mine[i]
            rest = mine[i + 1 :]
            if kind == "SINGLEDEL":
                j = i + 1
                while j < len(mine) and mine[j][1] == "SINGLEDEL":
                    j += 1
                if j == len(mine):
                    out.append((k, seq, "SINGLEDEL", None))
                elif mine[j][1] in ("SET", "MERGE"):
                    i = j + 1
                    continue
                else:
                    out.append((k, seq, "DEL", None))
            elif kind == "MERGE":
                kind = "MERGE"
                for s, other, v, _ in rest:
                    if other in gone:
                        kind = "SETWITHDEL"
                        break
                    val += v
                    if other != "MERGE":
                        kind = "SET"
                        break
                out.append((k, seq, kind, val))
            elif kind == "SET":
                out.append((k, seq, "SETWITHDEL" if any(e[1] in gone for e in rest) else "SET", val))
            elif kind == "DELSIZED":
                for s, other, v, n in rest:
                    if other == "DELSIZED":
                        val = v
                    elif other in gone or val is None or val != n:
                        kind, val = "DEL", None
                        break
                    else:
                        val = None
                out.append((k, seq, kind, val))
            else:
                out.append((k, seq, kind, val if kind == "SETWITHDEL" else None))
            break
    if bottom:
        out = [(k, s, "SET" if k == 0 and kind in ("MERGE", "SETWITHDEL") else kind, v) for k, s, kind, v in out if not (k == 0 and kind in gone)]
    return out


def test_compaction_of_every_kind(spark):
    r = random.Random(15)
    kinds = ["SET", "MERGE", "DEL", "SINGLEDEL", "SINGLEDEL", "DELSIZED", "SETWITHDEL", "LOGDATA"]
    log = [(r.randrange(60), s, k := r.choice(kinds), r.randrange(1, 4) if k == "DELSIZED" else r.randrange(100), r.randrange(1, 4)) for s in range(10, 400)]
    df = spark.createDataFrame(log, LOG + ", size long")
    for bottom, chunk in ((False, 1 << 20), (True, 50)):
        got = rows(maintain.compact(df, [120, 260], bottom, size="size", chunk=chunk), "key", "stripe", "seq", "kind", "val")
        want = [(key, *e) for key in range(60) for e in automaton([x[1:] for x in log if x[0] == key], [120, 260], bottom)]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_single_delete_runs(spark):
    log = spark.createDataFrame([(1, 9, "SINGLEDEL", 0), (1, 8, "SINGLEDEL", 0), (1, 7, "SET", 1), (1, 6, "SET", 2), (2, 9, "SINGLEDEL", 0), (2, 8, "DEL", 0), (3, 9, "SINGLEDEL", 0), (3, 8, "SET", 0)], LOG)
    assert rows(maintain.compact(log, []), "key", "seq", "kind", "val") == [(1, 6, "SET", 2), (2, 9, "DEL", None)]


def test_compaction_keeps_reads(spark):
    r = random.Random(5)
    log = spark.createDataFrame([(r.randrange(8), s, r.choice(["SET", "MERGE", "DEL", "DELSIZED", "SETWITHDEL", "LOGDATA"]), r.randrange(100)) for s in range(10, 200)], LOG)
    dels = spark.createDataFrame([(1, 4, 100), (3, 7, 150)], SPAN)
    for bottom in (False, True):
        small = maintain.compact(log, [80, 140], bottom, dels)
        for snapshot in (80, 140, 10**6):
            assert rows(view.resolve(small, dels, snapshot), "key", "val") == rows(view.resolve(log, dels, snapshot), "key", "val")


def test_internal_scan(spark):
    log = spark.createDataFrame([(1, 5, "SET", 9), (1, 7, "DEL", 0), (2, 5, "SET", 1), (3, 5, "MERGE", 1)], LOG)
    dels = spark.createDataFrame([(0, 9, 3), (2, 4, 4)], SPAN)
    marks = spark.createDataFrame([(0, 4, 4, "SET", 2, 1), (2, 6, 6, "DEL", 0, 0)], SPAN + ", kind string, suffix long, val long")
    points, deletions, ranges = view.internal_scan(log.where("key < 3"), dels, marks)
    assert rows(points, "key", "kind") == [(1, "DEL"), (2, "SET")]
    assert rows(deletions, "start", "stop", "seq") == [(0, 2, 3), (2, 4, 4), (4, 9, 3)]
    assert rows(ranges, "start", "stop", "kind") == [(0, 2, "SET"), (2, 4, "DEL"), (4, 6, "DEL")]
    with pytest.raises(Exception, match="MERGE"):
        view.internal_scan(log, dels, marks)[0].collect()


def test_fragments(spark):
    s = spark.createDataFrame([(0, 4, 1), (2, 6, 2)], SPAN)
    assert rows(spans.fragments(s), "start", "stop", "seq") == [(0, 2, 1), (2, 4, 1), (2, 4, 2), (4, 6, 2)]


def test_equal_seq_range_keys(spark):
    f = spark.createDataFrame([(0, 4, 7, "SET", 1, 5), (0, 4, 7, "DEL", 0, 0), (0, 4, 6, "SET", 2, 5)], SPAN + ", kind string, suffix long, val long")
    assert rows(spans.coalesce(f), "seq", "suffix") == [(7, 1)]


def test_masking_example(spark):
    points = spark.createDataFrame([(2, 2), (8, 5), (12, 8), (14, 4)], "key long, suffix long")
    marks = spark.createDataFrame([(5, 13, 9, "SET"), (8, 17, 6, "SET"), (6, 12, 3, "SET")], "start long, stop long, suffix long, kind string")
    assert rows(view.masked(points, marks, 7), "key") == [(2,), (12,)]


def test_seeks(spark):
    ks, ps = spark.createDataFrame([(k,) for k in (3, 9, 200)], "key long"), spark.createDataFrame([(p,) for p in (0, 3, 4, 150, 201)], "probe long")
    assert dict(rows(view.seek(ks, ps, True).na.fill(-1), "probe", "found")) == {0: 3, 3: 3, 4: 9, 150: 200, 201: -1}
    assert dict(rows(view.seek(ks, ps, False).na.fill(-1), "probe", "found")) == {0: -1, 3: -1, 4: 3, 150: 9, 201: 200}


def test_limits_and_steps(spark):
    ks = spark.createDataFrame([(k,) for k in (3, 9, 200)], "key long")
    ps = spark.createDataFrame([(0, 3), (4, 10), (201, 300)], "probe long, lim long")
    assert rows(view.seek(ks, ps, True, "lim").na.fill(-1), "probe", "found", "at_limit") == [(0, -1, True), (4, 9, False), (201, -1, False)]
    assert rows(view.steps(ks).na.fill(-1), "previous", "key", "next") == [(-1, 3, 9), (3, 9, 200), (9, 200, -1)]


def test_overlaps(spark):
    r = random.Random(2)
    a = [(i, lo := r.randrange(60), lo + r.randrange(9)) for i in range(40)]
    b = [(j, s := r.randrange(60), s + r.randrange(1, 9)) for j in range(40)]
    got = spans.overlaps(spark.createDataFrame(a, "i long, lo long, hi long"), spark.createDataFrame(b, "j long, start long, stop long"))
    assert rows(got, "i", "j") == sorted((i, j) for i, lo, hi in a for j, s, e in b if s <= hi and lo < e)


def test_mergers(spark):
    e = spark.createDataFrame([(1, 2, b"b"), (1, 1, b"a"), (2, 1, b"z")], "key long, seq long, value binary")
    assert [bytes(r[0]) for r in e.where("key = 1").agg(mergers.concatenate()).collect()] == [b"ab"]
    assert rows(mergers.custom(e, lambda v: b"".join(v) if len(v) > 1 else None), "key") == [(1,)]


def test_depth_and_empty(spark):
    f = spark.createDataFrame([(1, 5), (5, 9), (6, 7)], "smallest long, largest long")
    assert rows(stats.stabbing_depth(f), "depth") == [(2,)]
    assert view.resolve(spark.createDataFrame([], LOG)).count() == 0


def test_stream(spark, tmp_path):
    from millrace.streaming.latest import append_log, latest

    log = spark.createDataFrame([(1, 5, "SET", 9), (1, 6, "MERGE", 1), (2, 7, "SET", 3)], LOG)
    log.write.parquet(str(tmp_path / "in"))
    q = append_log(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert rows(latest(spark, str(tmp_path / "out")), "key", "val") == [(1, 10), (2, 3)]


def test_kept_state(spark, tmp_path):
    """Commit by commit the kept state reads like the whole log."""
    from millrace.streaming.latest import append_log, keep_latest, kept, latest, replay

    r, log = random.Random(8), []
    for number in range(3):
        more = [(r.randrange(6), 10 + 30 * number + s, r.choice(["SET", "MERGE", "DEL"]), r.randrange(100)) for s in range(30)]
        log += more
        spark.createDataFrame(more, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for run, name in ((keep_latest, "state"), (append_log, "log")):
            stream = spark.readStream.schema(LOG.replace(" long", " bigint")).parquet(str(tmp_path / "in"))
            run(stream, str(tmp_path / name), str(tmp_path / f"{name}-check")).awaitTermination()
        assert rows(kept(spark, str(tmp_path / "state")), "key", "val") == walk(log, [], 10**9)
    assert rows(latest(spark, str(tmp_path / "log")), "key", "val") == walk(log, [], 10**9)
    assert replay(spark, str(tmp_path / "log"), 1, 2).count() == 60
