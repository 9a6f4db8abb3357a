"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles. Documents of equal sets collapse first, so groups of exact
copies cost one row. Each permutation gives two signature values, its minimum and its maximum over the set;
bands of values propose pairs. Within a band's bucket every member is held against the bucket's smallest row;
where a bucket still spans several components, all its members are compared in blocks. Links are confirmed on the
full sets, buckets of every size alike. No step emits pairs that aren't linked, or all pairs of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, discard, join_hot, lean, least_ids, materialize, sorted_groups, with_row_key

#: A-Z to lower case and white space to blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: 32 bands of 4 values: a pair of similarity 0.75 shares none with a probability below 6e-6.
PERMUTATIONS, ROWS = 64, 4
#: A block of an open bucket aims at so many rows and shingles at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs of one left side that a task confirms at a time, about.
STAR = 100_000
_rng = np.random.default_rng(29)
_ODD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) * 2 + 1 for x in _rng.integers(0, 2**62, 8)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (fixed values: the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of the whole sequence if it is shorter."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < width:
        # a multiplier and an offset per place, as below, so the order of the words counts
        placed = mix(h * np.array(_BASE[: len(h)], np.uint64) + np.arange(1, len(h) + 1, dtype=np.uint64))
        return mix(np.array([placed.sum()], np.uint64) + np.uint64(len(h)))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out += mix(h[k : len(h) - width + 1 + k] * np.uint64(_BASE[k]) + np.uint64(k + 1))
    return np.unique(mix(out))


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    for k in range(PERMUTATIONS):
        y = found * _ODD[k]
        out[k] = y.min(), y.max()
    return out.reshape(-1)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mix(key ^ bands[:, k]) * np.uint64(_BASE[6])
    return key.view(np.int64)


def _signed(found: np.ndarray) -> int:
    return int(mix(found * np.uint64(_BASE[5])).sum().view(np.int64)) if len(found) else 0


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, text) to row, doc_id, size of the set, two digests of it and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), width)
                n.append(len(found))
                d1.append(_signed(found))
                d2.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(_BASE[4]))).view(np.int64)) if len(found) else 0)
                keys.append(band_keys(signature(found)) if len(found) else np.zeros(0, np.int64))
            columns = [pa.array(x, pa.int64()) for x in (n, d1, d2)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, lists], ["row", "doc_id", "n", "d1", "d2", "bands"])

    return docs.select("row", "doc_id", "text").mapInArrow(lean(run), "row long, doc_id long, n long, d1 long, d2 long, bands array<long>")


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """(rep, text) to (rep, set): the full set as the bytes of its sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["rep", "set"])

    return docs.select("rep", "text").mapInArrow(lean(run), "rep long, set binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A frequent a is copied once per salt, of which there are
    more the more rows there are, so no task gets all its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(batch.column(i) for i in range(4))):
                left, right = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both) and both:
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    salts = max(64, -(-total // STAR))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    left = pairs.select("a", "salt").distinct().join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a")
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    return pairs.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def block_links(percent: int) -> Callable[[pa.Table], pa.Table | None]:
    """Of two blocks of a bucket, links on full sets that span what the blocks join of different components."""

    def run(t: pa.Table) -> pa.Table | None:
        rep, label = t["rep"].to_numpy(), np.unique(t["c"].to_numpy(), return_inverse=True)[1]
        first = {k: t[k][0].as_py() for k in ("cls_lo", "lo", "cls_hi", "hi")}
        cls, mine = t["cls"].to_numpy(), t["mine"].to_numpy()
        low = np.flatnonzero((cls == first["cls_lo"]) & (mine == first["lo"]))
        high = np.flatnonzero((cls == first["cls_hi"]) & (mine == first["hi"]))
        if not len(low) or not len(high) or len(rep) < 2:
            return None
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["set"]]
        n = np.array([len(x) for x in sets])
        # shingles numbered within the two blocks
        known, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(n)])
        mark, out = np.zeros(len(known), bool), []
        held, numbers, starts = None, number, ends
        for i in low.tolist():
            open_ = high[(label[high] != label[i]) & (100 * np.minimum(n[high], n[i]) >= percent * np.maximum(n[high], n[i]))]
            if not len(open_):
                continue
            if held is None or len(open_) != len(held) or (open_ != held).any():
                held = open_
                numbers = np.concatenate([number[ends[j] : ends[j + 1]] for j in held])
                starts = np.concatenate([[0], np.cumsum(n[held])[:-1]])
            own = number[ends[i] : ends[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[numbers], starts, dtype=np.int64)
            mark[own] = False
            near = held[100 * both >= percent * (n[held] + n[i] - both)]
            while len(near := near[label[near] != label[i]]):
                j = near[0]
                out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())}) if out else None

    return run


def open_links(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of different components in the buckets of (band, rep, c, n), found by full sets, however large a bucket is.

    A bucket that fits a block is one. Of a larger one, sets that are similar enough differ in size by 100 / percent
    at most, so it is cut into classes of that ratio, and a block meets those of its own and the next class only.
    Blocks are dealt by a hash of rep.
    """
    ratio = max(math.log(100 / percent) * 1.000001, 0.01)
    many = materialize(many.select("band", "rep", "c", "n", F.floor(F.log("n") / ratio).cast("int").alias("cls")), "open")
    sets = sets.join(many.select("rep").distinct(), "rep", "left_semi")
    sizes = many.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words"))
    total, fits = many.count(), (F.col("rows") <= BLOCK) & (F.col("words") <= BLOCK_SHINGLES)
    all_ = materialize(join_hot(many, sizes, ["band"], "rows", total).withColumn("fits", fits).drop("rows", "words"), "sized")
    zero = F.lit(0).cast("long")
    whole = all_.where("fits").select("band", "rep", "c", F.lit(0).alias("cls"), zero.alias("mine"), F.lit(0).alias("cls_lo"), zero.alias("lo"), F.lit(0).alias("cls_hi"), zero.alias("hi"))
    large = all_.where("not fits").drop("fits")
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_SHINGLES / F.exp((F.col("cls") + 1) * ratio))))
    blocks = large.groupBy("band", "cls").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / per))
    up, down = (blocks.select("band", (F.col("cls") + k).alias("cls"), F.col("blocks").alias(name)) for k, name in ((-1, "up"), (1, "down")))
    blocks = blocks.join(up, ["band", "cls"], "left").join(down, ["band", "cls"], "left")
    spread = join_hot(large, blocks, ["band", "cls"], "size", total).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    each = lambda size, f: F.when(F.col(size) > 0, F.transform(F.sequence(zero, F.col(size) - 1), f)).otherwise(F.array().cast("array<struct<cls_lo:int,lo:bigint,cls_hi:int,hi:bigint>>"))
    meets = lambda c, x, d, y: F.struct(c.cast("int").alias("cls_lo"), x.alias("lo"), d.cast("int").alias("cls_hi"), y.alias("hi"))
    cls, mine = F.col("cls"), F.col("mine")
    met = F.concat(
        each("blocks", lambda j: meets(cls, F.least(mine, j), cls, F.greatest(mine, j))),
        each("up", lambda j: meets(cls, mine, cls + 1, j)),
        each("down", lambda j: meets(cls - 1, j, cls, mine)),
    )
    spread = spread.select("band", "rep", "c", "cls", "mine", F.explode(met).alias("met")).select("band", "rep", "c", "cls", "mine", "met.*")
    rows = whole.unionByName(spread).join(sets, "rep")
    return sorted_groups(rows, ["band", "cls_lo", "lo", "cls_hi", "hi"], block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents with 100 * |A and B| >= percent * |A or B|. Null texts and those without words have an
    empty set and link with nothing. Rows are told apart by a key of their own: rows of equal ids are documents of
    their own, and component_id is the least id among a component's rows, null if it has none; kept says whether a
    row's id is that id. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return near_rows(with_row_key(rows, "row"), width, percent)


def near_rows(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """near_duplicates of (row, doc_id, text) whose rows have distinct keys already; `row` comes too."""
    names = ["d1", "d2", "n"]
    found = materialize(sketch(docs, width), "sketch")
    total = found.count()
    sets = found.where("n > 0").groupBy(*names).agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    sets = materialize(sets, "sets")
    reps = materialize(found.select(F.col("row").alias("rep"), "bands").join(sets.select("rep", "n"), "rep").select("rep", "n", F.explode("bands").alias("band")), "bands")
    shared = reps.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("first")).where("c > 1")
    buckets = materialize(join_hot(reps, shared, ["band"], "c", reps.count()).drop("c"), "buckets")
    discard(reps)
    texts = docs.select(F.col("row").alias("rep"), "text").join(buckets.select("rep").distinct(), "rep", "left_semi")
    full = materialize(set_rows(texts, width), "full")
    pairs = buckets.where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(confirm(pairs, full, percent, total), "links")
    ends = components(links)
    within = materialize(buckets.join(ends.select(F.col("id").alias("rep"), F.col("component_id").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep")), "within")
    discard(buckets)
    spans = within.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("band", "size")
    left = join_hot(within, spans, ["band"], "size", within.count())
    new = materialize(open_links(left, full, percent), "links")
    discard(within, full)
    if not new.isEmpty():
        ends = components(links.union(new))
    named = sets.join(least_ids(ends, sets).withColumnRenamed("id", "rep"), "rep", "left")
    named = materialize(named.select(*names, "size", F.when(F.col("least_id").isNull(), F.col("least")).otherwise(F.col("least_id")).alias("c")), "named")
    some = join_hot(found.where("n > 0").select("row", "doc_id", *names), named, names, "size", total).select("row", "doc_id", "n", "c")
    out = some.union(found.where("n = 0").select("row", "doc_id", "n", "doc_id"))
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("c").eqNullSafe(F.col("doc_id")).alias("kept"))
