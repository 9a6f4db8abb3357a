"""One query per operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import license_scan

    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import decontam

    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import embed_dedup

    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import pii

    return pii.find_pii(table(spark, sf_dir, "documents"), redacted=False).drop("redacted")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import substring

    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digest_rows(chat.format_conversations(rows.unionByName(more)))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import shard

    return shard.shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_language": op3_language,
    "op4_pack": op4_pack,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_minhash": op6_minhash,
    "op7_pii": op7_pii,
    "op8_substring": op8_substring,
    "op9_chat_format": op9_chat_format,
    "op10_shard": op10_shard,
}
