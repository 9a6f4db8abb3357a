"""Removal of repeated passages by difference-cover anchors.

Anchors are short windows of words that start at places p with p mod 21 in a difference cover: for any two places
there is a shift under 21 that takes both onto the cover, so two equal windows of 35 words share an anchor of 15.
Only windows around anchors that occur more than once are then hashed whole, which extends a shared anchor to the
question whether the window occurs elsewhere. Windows count as equal by 96 bits of two hashes over 128-bit hashes of
their words: of 10^12 windows some two are taken for equal wrongly with a probability below 10^-5. Occurrences of one hash are sorted together and read as a
stream of neighbours: no group is ever collected and no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, lean, materialize, with_row_key

#: A perfect difference set modulo 21.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Bits of a place; above them stand 32 bits of a window's second hash.
PLACE = 31
_B, _C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits of each word, in two columns."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def window_hashes(h: np.ndarray, width: int, base: int = _B) -> np.ndarray:
    """A 64-bit hash of the `width` words from each place, of one column of word hashes."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    power, inverse = (np.ones(n + 1, np.uint64) for _ in range(2))
    power[1:], inverse[1:] = np.uint64(base), np.uint64(pow(base, -1, 2**64))
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=total[1:])
    out = (total[width:] - total[: n - width + 1]) * inverse[: n - width + 1]
    return out ^ (out >> np.uint64(32))


def _rows(h: list[np.ndarray], row: list[np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
    """A batch's places; `at` holds a place and, above its 31 bits, what more the hash has. What occurs twice in the batch
    needs no hash any more (null); a row of -1 stands for it elsewhere."""
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    h, row, at = join(h, np.uint64).view(np.int64), join(row, np.int64), join(at, np.int64)
    order = np.lexsort((at, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (at[order[1:]] >> PLACE != at[order[:-1]] >> PLACE)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(h)))
    more, known = order[start[count > 1]], np.zeros(len(h), bool)
    known[order] = np.repeat(count > 1, count)  # places stay in the order of the text, which packs well
    blank = np.zeros(len(more), np.int64)
    hashes = pa.array(np.concatenate([h, h[more]]), mask=np.concatenate([known, blank > 0]))
    return pa.RecordBatch.from_arrays([hashes, pa.array(np.concatenate([row, blank - 1])), pa.array(np.concatenate([at, at[more]]))], ["h", "row", "at"])


def repeated(places: DataFrame) -> DataFrame:
    """Of (h, row, at) the places whose hash occurs more than once."""

    def plain(t: pa.Table) -> pa.Table:
        at = (t.column(1).to_numpy() & ((1 << PLACE) - 1)).astype(np.int32)
        return pa.table({"row": t.column(0), "at": at})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last place, whose next neighbour isn't known yet
        follows = False  # whether it is like the one before it
        for batch in batches:
            sure = batch.column(0).is_null()
            t = pa.Table.from_batches([batch])
            yield from plain(t.filter(sure).select([1, 2])).to_batches()
            t = t.filter(pa.compute.invert(sure))
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            h, g = t.column(0).to_numpy(), t.column(2).to_numpy() >> PLACE
            same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            back = np.concatenate([[follows], same])
            yield from plain(t.select([1, 2]).slice(0, len(h) - 1).filter(pa.array(back[:-1] | same))).combine_chunks().to_batches()
            held, follows = t.slice(len(h) - 1), bool(back[-1])
        if held is not None and follows:
            yield from plain(held.select([1, 2])).combine_chunks().to_batches()

    key = F.coalesce("h", F.xxhash64("row", "at"))
    return places.repartition(key).sortWithinPartitions("h", "at").mapInArrow(lean(run), "row long, at int").where("row >= 0")


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept.

    A word goes if a window over it occurs at any other place, judged on the input. Null texts have no words. Places
    are held by a key of the row, so ids may be null or repeated; other columns are ignored; no rows give no rows.
    """
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"a window has to be at least {PERIOD} words")
    docs = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "row")
    texts = docs.select("row", "text")
    cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if len(words) >= window:
                    h = window_hashes(word_hashes(words)[:, 0], anchor)
                    at = np.flatnonzero(np.resize(cover, len(h)))
                    for column, x in zip(out, (h[at], np.full(len(at), row, np.int64), at.astype(np.int64))):
                        column.append(x)
            yield _rows(*out)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = word_hashes(words_of(text.as_py()))
                h, g = window_hashes(words[:, 0], window), (window_hashes(words[:, 1], window, _C) >> np.uint64(32)).astype(np.int64)
                near = np.zeros(len(h) + 1, np.int64)
                at = places.values.to_numpy()
                np.add.at(near, np.clip(at - (window - anchor), 0, len(h)), 1)
                np.add.at(near, np.clip(at + 1, 0, len(h)), -1)
                at = np.flatnonzero(np.cumsum(near)[:-1])
                for column, x in zip(out, (h[at], np.full(len(at), row, np.int64), at.astype(np.int64) | g[at] << PLACE)):
                    column.append(x)
            yield _rows(*out)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, texts = [], [], [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                n.append(len(words))
                if places.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = places.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                gone.append(n[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "surrogatepass"))
            columns = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    place = "h long, row long, at long"
    by_row = lambda df: df.groupBy("row").agg(F.collect_list("at").alias("places"))  # noqa: E731  a document's own places
    shared = materialize(by_row(repeated(texts.mapInArrow(lean(anchors), place))), "anchors")
    # written down, so the shuffle of all texts goes before that of the windows begins
    some = materialize(texts.join(shared, "row"), "candidates")
    discard(shared)
    found = materialize(by_row(repeated(some.mapInArrow(lean(windows), place))), "windows")
    discard(some)
    return docs.join(found, "row", "left").select("doc_id", "text", "places").mapInArrow(lean(keep), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
