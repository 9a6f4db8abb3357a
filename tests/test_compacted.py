"""Reads of a compacted log, as it was written."""

from millrace.operators import maintain, view


def test_merges_over_a_deletion_stay(spark):
    log = spark.createDataFrame([(1, 20, "SET", 9), (1, 90, "DEL", 0), (1, 95, "MERGE", 4), (2, 90, "DEL", 0)], "key long, seq long, kind string, val long")
    for bottom in (False, True):
        small = maintain.compact(log, [80, 140], bottom)
        assert ("SETWITHDEL" in {r["kind"] for r in small.collect()})
        for snapshot in (80, 140, 10**6):
            read = lambda x: sorted((r["key"], r["val"]) for r in view.resolve(x, None, snapshot).collect())
            assert read(small) == read(log)
