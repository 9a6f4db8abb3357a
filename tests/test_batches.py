import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.functions.batches import ParseBatch, decode, encode

OPS = [("SET", b"a", b"1"), ("LOGDATA", b"note", None), ("DEL", b"b", None), ("RANGEDEL", b"a", b"c" * 300)]


def test_round_trip(spark):
    data = encode(10, OPS)
    assert [(k, key, v) for _, k, key, v in decode(data)] == OPS
    assert [s for s, *_ in decode(data)] == [10, 11, 11, 12]
    with pytest.raises(ValueError):
        list(decode(data[:-1]))
    spark.udtf.register("parse_batch", ParseBatch)
    spark.createDataFrame([(bytearray(data),)], "b binary").createOrReplaceTempView("batches")
    assert spark.sql("select p.kind from batches, lateral parse_batch(b) p").count() == 4


def test_keys(spark):
    r = spark.sql("select 'foo@10' k, 'bar' p, X'61' b").select(keys.prefix(F.col("k")), keys.suffix(F.col("k")), keys.suffix(F.col("p")), keys.abbreviated(F.col("b")), F.hex(keys.immediate_successor(F.col("b")))).first()
    assert tuple(r) == ("foo", 10, None, "6100000000000000", "6100")
    t = spark.range(1).select(keys.trailer(F.lit(7).cast("long"), F.lit(1).cast("long")).alias("t"))
    assert tuple(t.select(keys.trailer_seq(F.col("t")), keys.trailer_kind(F.col("t"))).first()) == (7, 1)
