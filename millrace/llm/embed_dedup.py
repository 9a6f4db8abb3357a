"""Near-duplicate vectors by binary codes after a random rotation.

Equal vectors collapse first. What is stored of a vector is its code (the signs of its rotated coordinates), the
code's correction factor and its rotated coordinates in eight bits, rounded at random; bands of code bits propose
pairs within a label. A pair's inner product is estimated without bias from one side's code and factor and the
other's coordinates, with a confidence bound. Vectors are fetched only for the rows of pairs that the bound leaves
open, and only those pairs are computed again. A pair counts in the first band that it shares. Large buckets are
dealt out as pairs of blocks; what comes out of a block is a number of links and a label per vector, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, discard, join_hot, lean, least_ids, materialize, sorted_groups, with_row_key

#: Largest miss probability of a pair at the threshold by its bands, rows that a block aims at, width of the bound.
MISS, BLOCK, SIGMAS = 1e-6, 1024, 5.0
GROUP = ["label", "band", "key", "lo", "hi"]


def rotations(dim: int, n: int, seed: int = 11) -> np.ndarray:
    """n random orthogonal matrices."""
    r = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(n)])


def layout(rows: int, cosine: float) -> tuple[int, int]:
    """Bits of a band and number of bands."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(24, max(8, math.ceil(math.log2(max(2, rows) / 1000))))
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(vectors: np.ndarray, turns: np.ndarray, bits: int, bands: int, seed: int = 5) -> tuple[np.ndarray, ...]:
    """Of unit vectors: band keys, packed code, factor <code, vector>, coordinates in eight bits, their step."""
    first = vectors @ turns[0].T
    signs = np.concatenate([vectors @ t.T for t in turns], axis=1)[:, : bits * bands] >= 0
    keys = signs.reshape(len(vectors), bands, bits) @ (1 << np.arange(bits))
    step = np.abs(first).max(axis=1) / 127
    rounded = np.floor(first / step[:, None] + np.random.default_rng(seed).random(first.shape))
    factor = np.abs(first).sum(axis=1) / math.sqrt(vectors.shape[1])
    return keys, np.packbits(first >= 0, axis=1), factor, np.clip(rounded, -127, 127).astype(np.int8), step


def bounds(factor: np.ndarray, step: np.ndarray, cosine: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """How far below the threshold the estimate of a pair that reaches it may lie: by the code, and by the rounding.

    Of a pair at a cosine t >= cosine the part across the code's vector has the length (1 - t^2)^0.5, and the code's own
    part across has (1 - factor^2)^0.5; their product is random with a deviation of 1 / (dim - 1)^0.5.
    """
    across = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * math.sqrt(1 - cosine**2)
    return across * min(1.0, SIGMAS / math.sqrt(max(1, dim - 1))) + 1e-6, SIGMAS * step / 2 / factor.min()


def open_pairs(code: np.ndarray, factor: np.ndarray, coordinates: np.ndarray, step: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of left and right whose estimate and bound leave it open that they reach the cosine."""
    dim = coordinates.shape[1]
    signs = np.unpackbits(code[left], axis=1, count=dim).astype(np.float32) * 2 - 1
    held = coordinates[right].astype(np.float32) * step[right, None].astype(np.float32)
    estimate = signs @ held.T / math.sqrt(dim) / factor[left][:, None]
    by_code, by_rounding = bounds(factor, step, cosine, dim)
    i, j = np.nonzero(estimate + by_code[left][:, None] + by_rounding[right][None, :] >= cosine)
    return left[i], right[j]


def _held(t: pa.Table, name: str, kind: type) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(t.num_rows, -1)


def _candidates(t: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The open pairs of a group whose first shared band is the group's."""
    lo, hi, band = (t[k][0].as_py() for k in ("lo", "hi", "band"))
    mine = t["mine"].to_numpy()
    left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right) or t.num_rows < 2:
        return none, none
    i, j = open_pairs(_held(t, "code", np.uint8), t["factor"].to_numpy(), _held(t, "coordinates", np.int8), t["step"].to_numpy(), left, right, cosine)
    if lo == hi:
        i, j = i[i < j], j[i < j]
    if band and len(i):
        keys = _held(t, "keys", np.uint8)
        size = keys.shape[1] // t["bands"][0].as_py()
        same = (keys[i, : band * size] == keys[j, : band * size]).reshape(len(i), band, size).all(axis=2).any(axis=1)
        i, j = i[~same], j[~same]
    return i, j


def proposer(cosine: float) -> Callable[[pa.Table], pa.Table | None]:
    """The rows of a group that are in an open pair."""

    def run(t: pa.Table) -> pa.Table | None:
        i, j = _candidates(t, cosine)
        return t.take(pa.array(np.unique(np.concatenate([i, j])))) if len(i) else None

    return run


def linker(cosine: float) -> Callable[[pa.Table], pa.Table | None]:
    """(rep, other, links) of a group's rows with vectors: open pairs computed again; other is the least rep that a
    row's links in the group reach."""

    def run(t: pa.Table) -> pa.Table | None:
        i, j = _candidates(t, cosine)
        v = unit(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)) if len(i) else None
        hit = np.concatenate([np.einsum("ij,ij->i", v[i[a : a + 65536]], v[j[a : a + 65536]]) >= cosine for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
        i, j = i[hit], j[hit]
        if not len(i):
            return None
        rep, m = t["rep"].to_numpy(), t["m"].to_numpy()
        links, least = np.zeros(len(rep), np.int64), rep.copy()
        np.add.at(links, i, m[j])
        np.add.at(links, j, m[i])
        while True:
            low = np.minimum(least[i], least[j])
            if (least[i] == low).all() and (least[j] == low).all():
                break
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "other": least[some], "links": links[some]})

    return run


def stored(sets: DataFrame, kind: str, dim: int, bits: int, bands: int, turns: np.ndarray) -> DataFrame:
    """(label, rep, v) to what the search keeps of each vector."""
    width = -(-bits // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(2).flatten().to_numpy().reshape(n, dim)
            keys, code, factor, coordinates, step = encode(unit(v), turns, bits, bands)
            packed = np.ascontiguousarray(keys.astype("<u4")).view(np.uint8).reshape(n, bands, 4)[:, :, :width].reshape(n, -1)
            binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists, pa.array(np.full(n, bands, np.int32)), binary(packed), binary(code), pa.array(factor), binary(coordinates), pa.array(step)],
                ["label", "rep", "found", "bands", "keys", "code", "factor", "coordinates", "step"],
            )

    schema = f"label {kind}, rep long, found array<int>, bands int, keys binary, code binary, factor double, coordinates binary, step double"
    return sets.select("label", "rep", "v").mapInArrow(lean(run), schema)


def dealt(codes: DataFrame) -> DataFrame:
    """A row per code, band and pair of blocks that it is compared in; blocks are dealt by a hash of rep."""
    each = codes.select("label", F.posexplode("found").alias("band", "key"), *[c for c in codes.columns if c not in ("label", "found")])
    names = ["label", "band", "key"]
    large = codes.select("label", F.posexplode("found").alias("band", "key")).groupBy(*names).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK)
    large = materialize(large.select(*names, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "large")
    zero = F.lit(0).cast("int")
    small = each.join(large, names, "left_anti").select("*", zero.alias("mine"), zero.alias("lo"), zero.alias("hi"))
    many = each.join(large, names).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    many = many.withColumn("theirs", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    many = many.withColumn("lo", F.least("mine", "theirs")).withColumn("hi", F.greatest("mine", "theirs")).drop("blocks", "theirs")
    return small.unionByName(many)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, embedding, label) to one row per vector: vec_id, n_links, component_id, kept.

    Linked are vectors of the same label, not null, at a cosine of at least `cosine`. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. Rows are told apart by a key of their own: equal
    ids are vectors of their own, and component_id is the least id among a component's rows, null if it has none;
    kept says whether a row's id is that id. Vectors of another length than most are compared with their own length
    only. Other columns are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    sound = F.coalesce(F.size("v") > 0, F.lit(False)) & F.col("label").isNotNull()
    sound &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    digest = [F.xxhash64(F.lit(k), "v").alias(f"d{k}") for k in (1, 2)]  # 128 bits of the vector
    rows = with_row_key(rows.select("*", F.coalesce(sound, F.lit(False)).alias("ok"), *digest), "row")
    names = ["label", "d1", "d2"]
    sets = rows.where("ok").groupBy(*names).agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"))
    sets = materialize(sets.join(rows.select(F.col("row").alias("rep"), "v"), "rep"), "distinct")
    kind, schema = dict(sets.dtypes)["label"], "rep long, other long, links long"
    found = []
    for dim, n in ((r[0], r[1]) for r in sets.groupBy(F.size("v")).agg(F.count(F.lit(1))).collect()):  # one row per length
        bits, bands = layout(n, cosine)
        own = sets.where(F.size("v") == dim)
        codes = materialize(stored(own, kind, dim, bits, bands, rotations(dim, -(-bits * bands // dim))), "codes")
        left = materialize(sorted_groups(dealt(codes), GROUP, proposer(cosine), _open_schema(kind)), "open")
        left = left.join(own.select("rep", "m", "v"), "rep")
        found.append(materialize(sorted_groups(left, GROUP, linker(cosine), schema), "links"))
        discard(codes)
    links = vectors.sparkSession.createDataFrame([], schema)
    for part in found:
        links = links.union(part)
    ends = least_ids(components(links, "rep", "other"), sets)
    counts = links.groupBy("rep").agg(F.sum("links").alias("k"))
    named = sets.drop("v").join(counts, "rep", "left").join(ends.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select(*names, "m", (F.coalesce("k", F.lit(0)) + F.col("m") - 1).alias("n"), F.when(F.col("least_id").isNull(), F.col("least")).otherwise(F.col("least_id")).alias("c"))
    named = materialize(named, "named")
    some = join_hot(rows.where("ok").select("vec_id", *names), named, names, "m", rows.count()).select("vec_id", "n", "c")
    out = some.union(rows.where("not ok").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.col("c").eqNullSafe(F.col("vec_id")).alias("kept"))


def _open_schema(kind: str) -> str:
    own = "rep long, bands int, keys binary, code binary, factor double, coordinates binary, step double"
    return f"label {kind}, band int, key int, {own}, mine int, lo int, hi int"
