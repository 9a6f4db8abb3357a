"""Writes: batches of operations become numbered entries of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import FIRST_SEQ


def numbered(batch: DataFrame, base: int | Column) -> DataFrame:
    """A batch's operations, each with the number base + ordinal; ordinals count from 0 without gaps.

    The batch is visible as a whole or not at all: it is one append.
    """
    return batch.withColumn("seq", F.col("ordinal").cast("long") + F.lit(base)).drop("ordinal")


def joined(batches: list[DataFrame]) -> DataFrame:
    """Batches one after another in one: later ordinals move up by the counts before, which are read with the query."""
    out, start = [], F.lit(0)
    for batch in batches:
        out.append(batch.withColumn("ordinal", F.col("ordinal") + start))
        start = start + batch.agg(F.count(F.lit(1))).scalar()
    return reduce(DataFrame.unionByName, out)


def next_number(log: DataFrame) -> Column:
    """The number that the next write gets, and the snapshot that sees all; read with the query that it is part of."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(FIRST_SEQ - 1)) + 1).scalar()


def batch_summary(batch: DataFrame) -> DataFrame:
    """One row: n (operations that take a number), n_log, empty, and which kinds a batch (kind, ordinal) holds."""
    note = F.col("kind") == "LOGDATA"
    return batch.agg(F.count_if(~note).alias("n"), F.count_if(note).alias("n_log"), (F.count(F.lit(1)) == 0).alias("empty"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def commit(batch: DataFrame, log: DataFrame, path: str) -> None:
    """Number a batch after a stored log and append it: one directory, visible as a whole or not at all."""
    numbered(batch, next_number(log)).write.mode("append").parquet(path)
