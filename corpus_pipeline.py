"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, minhash, packing, pii
from millrace.llm.common import discard, free_name, join_hot, materialize, scratch, with_row_key

#: A document's language has to be this sure; an even guess between four languages is 0.25.
LEAST_SCORE = 0.34


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, those without a letter and those that no language fits. Each row is
    judged where it lies, so null and repeated ids are no special case; no rows give no rows."""
    return materialize(langid.with_language(docs, LEAST_SCORE), "languages")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: of the smallest id, null ids last, and of equal ids any one.

    Rows are told apart by a key of their own, so ids may be null, repeated or shared by different texts.
    """
    key = free_name(docs, "_row")
    rows = with_row_key(docs, key)
    found = minhash.near_rows(rows.select(F.col(key).alias("row"), F.col(key).alias("doc_id"), "text")).select("row", "component_id")
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    grouped = materialize(found.join(ids, "row"), "groups")
    first = grouped.groupBy("component_id").agg(F.min(F.struct("unnamed", "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("size"))
    gone = join_hot(grouped, first.where("size > 1"), ["component_id"], "size", grouped.count()).where("row != first.row").select(F.col("row").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, each row judged by its own text.

    Null and empty texts hold nothing and stay; null and repeated ids, repeated rows, an empty table or benchmark are
    no special case.
    """
    key = free_name(docs, "_row")
    rows = with_row_key(docs, key)
    found = decontam.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    gone = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return rows.join(gone, key, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes <KIND>; no document goes."""
    clean = pii.redact_column(docs, "text")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Null and empty texts are a piece of the closing id; repeated rows are pieces of
    their own; null ids stay null; no rows give no rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: Trained and hashed stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote goes once the next has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
