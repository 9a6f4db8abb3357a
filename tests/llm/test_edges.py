"""Nulls, repeated rows, empty tables and extra columns with clashing names: a defined result each, and no crash."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, decontam, embed_dedup, langid, license_scan, minhash, packing, pii, shard, substring

#: Names that the operators use inside.
CLASH = ("h", "at", "n", "sig", "rep", "band", "bands", "c", "places", "length", "piece", "size", "shard", "slot", "label", "kept", "item_id", "score", "_p", "_h", "_r", "_b", "a", "b")
LONG = "word " * 40_000


def documents(spark):
    rows = [(1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (2, None, None), (3, "", "en"), (None, "no id here", "de"), (4, LONG, None), (5, "x" * 100_000, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def wide(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


BY_ROW = {
    "license": lambda d: license_scan.scan_licenses(d),
    "language": lambda d: langid.identify(d),
    "pii": lambda d: pii.find_pii(d),
    "shard": lambda d: shard.shard_rows(d, 3),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_a_row_per_row(spark, name):
    df = documents(spark)
    plain, clashing = BY_ROW[name](df).collect(), BY_ROW[name](wide(df)).collect()
    assert len(plain) == df.count() == len(clashing)
    key = lambda rows: sorted(map(repr, rows))
    assert key(plain) == key(clashing)
    assert BY_ROW[name](wide(df).limit(0)).count() == 0


def test_packing_keeps_every_row(spark):
    TOKENS = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    df = documents(spark)
    rows = packing.pack(wide(df), TOKENS).collect()
    assert sum(r["piece"] == 0 for r in rows) == df.count()
    assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3)) == 2
    assert max(r["offset"] + r["length"] for r in rows) <= 2048
    assert packing.pack(wide(df).limit(0), TOKENS).count() == 0


def test_groups(spark):
    df = documents(spark)
    for find in (minhash.near_duplicates, substring.remove_repeats):
        plain, clashing = find(df).collect(), find(wide(df)).collect()
        assert sorted(map(repr, plain)) == sorted(map(repr, clashing)) and len(plain) == df.count()
        assert find(wide(df).limit(0)).count() == 0
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect()}
    assert gone == {1: (6, 0), 2: (0, 0), 3: (0, 0), None: (3, 0), 4: (40_000, 40_000), 5: (1, 0)}
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (None, "g h i j k l"), (None, "m n o p q r"), (5, "m n o p q r"), (6, "m n o p q r"), (None, "only"), (7, None), (7, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, 1, True), (1, 1, True), (None, 1, False), (None, 5, False), (5, 5, True), (6, 5, False), (None, None, True), (7, 7, True), (7, 7, True)]
    assert sorted([(r["doc_id"], r["component_id"], r["kept"]) for r in got], key=repr) == sorted(want, key=repr)


def test_leaks(spark):
    df = documents(spark)
    items = spark.createDataFrame([(7, "two three four"), (8, None), (9, ""), (7, "two three four")], "item_id long, text string")
    got = decontam.find_leaks(wide(df), items.withColumn("h", F.lit(1)))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 7)}
    assert decontam.find_leaks(wide(df).limit(0), items).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [None, 1.0], 1), (4, None, None), (5, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    for table in (df, df.withColumns({c: F.lit("x") for c in CLASH if c not in ("label",)})):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(table).collect()}
        assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True)}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_turns(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (None, 0, "user", "b"), (1, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("run", F.lit("x")).withColumn("segments", F.lit("x"))
    got = {r["conv_id"]: (r["n_turns"], r["valid"]) for r in chat.digest_rows(chat.format_conversations(df)).collect()}
    assert got == {1: (3, False), None: (1, False)}


def test_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("score", F.lit("clash")), "/root/testdata/sf0.001")
        assert out.columns == [*docs.columns, "score"], name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
