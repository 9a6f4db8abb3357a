"""Sharding by a hypergeometric communication matrix, in built-in functions only.

Rows get a key of their own and lie in logical partitions by a hash of it; keys are written down first, so that a
lost task repeats the same draw and no id, null or repeated, fills a partition. How many rows
each partition sends to each shard is drawn exactly: the joint law of a uniform shuffle with given shard sizes
is multivariate hypergeometric. Each partition permutes its rows by a keyed hash and cuts the permutation at
its row of the matrix; each shard permutes what it got by a second hash. Only partition counts reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import gapless_rank, materialize, with_row_key

#: Logical partitions: rows each aims at, and the bounds of their number. The bounds also bound what is broadcast.
ROWS_PER_PARTITION, LEAST_PARTITIONS, MOST_PARTITIONS = 200_000, 64, 8192


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good. numpy's generator ends at 10**9; beyond, by inversion."""
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    mean = draws * (good / total)
    spread = 12 * (mean * (bad / total) * ((total - draws) / (total - 1))) ** 0.5 + 12
    low, high = max(0, draws - bad, int(mean - spread)), min(good, draws, int(mean + spread) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """matrix[p][s]: rows that partition p sends to shard s; row sums are counts, column sums are sizes."""
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            k = hypergeometric(rng, room, rest - room, n)
            row.append(k)
            rest -= room
            n -= k
        left = [room - k for room, k in zip(left, row)]
        out.append(row)
    return out


def shard_rows(docs: DataFrame, n_shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes plus 8), text_crc32, shard, slot.

    A uniform random assignment whose shard sizes differ by one row at most (the law `rows`); slots are 0, 1, ... in
    each shard. Equal texts aren't kept together: each row is drawn on its own. Null texts have no bytes; null ids and
    repeated rows are rows of their own; no rows give no rows; other columns are ignored. The result depends on the
    rows, the order in which the table is read, and the seed.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")
    )
    rows = with_row_key(rows, "_row")
    total = rows.count()
    parts = min(MOST_PARTITIONS, max(LEAST_PARTITIONS, -(-total // ROWS_PER_PARTITION)))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64(F.lit(seed), F.col("_row")), F.lit(parts)).cast("int"))
    found = {r[0]: r[1] for r in rows.groupBy("_p").agg(F.count(F.lit(1))).collect()}  # at most MOST_PARTITIONS rows
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    order = sorted(found)
    matrix = communication_matrix([found[p] for p in order], sizes, seed)
    # at most MOST_PARTITIONS rows of n_shards - 1 numbers are broadcast
    cuts = spark.createDataFrame([(p, [int(x) for x in np.cumsum(row)[:-1]]) for p, row in zip(order, matrix)], "cut_p int, cuts array<long>")
    shuffled = Window.partitionBy("_p").orderBy(F.xxhash64(F.lit(seed + 1), F.col("_row")), "_row")
    local = rows.withColumn("_r", F.row_number().over(shuffled) - 1)
    sent = local.join(F.broadcast(cuts), F.col("_p") == F.col("cut_p")).select(
        id_col,
        "size",
        "text_crc32",
        F.size(F.filter("cuts", lambda c: c <= F.col("_r"))).alias("shard"),
        F.xxhash64(F.lit(seed + 2), F.col("_row")).alias("_h"),
        "_row",
    )
    return gapless_rank(materialize(sent, "sent"), ["shard"], ["_h", "_row"], total, "slot").drop("_h", "_row")
