"""Benchmark decontamination by the q-gram lemma over diagonal bands and banded alignment.

Texts and items are lower-cased, runs of white space become one blank, and both are compared by characters. An item
of n characters at an edit distance of at most e from a region shares n + 1 - q (e + 1) of its q-grams with it, all on
diagonals that differ by e at most; q is chosen per item so that this is one or more. Distinct shared q-grams are
counted in bands of 2 (e + 1) diagonals that overlap by half. Bands of an item that reach the count and touch are
joined; a second count of short grams and an alignment limited to the band's diagonals verify them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, spread

#: Longest grams of the search, grams of the second count, edits per character, bits of a gram's hash that a table holds.
Q, FINE, RATE, BITS = 10, 4, 0.07, 21
#: Items go to the executors in blocks of so many characters; hits of a text are expanded so many at a time.
BLOCK_CHARS, HITS = 8_000_000, 1 << 20
_B = 0x9E3779B97F4A7C15


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q characters at each place: a polynomial by doubling, then mixed."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, codes, 1
    while True:
        if q & size:  # what is taken so far, then this power behind it
            out = power[have : have + n] if out is None else out * np.uint64(pow(_B, size, 2**64)) + power[have : have + n]
            have += size
        if have == q:
            break
        power = power[:-size] * np.uint64(pow(_B, size, 2**64)) + power[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def budget(n: int) -> int:
    return int(RATE * n)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of text nearest to item on the diagonals low to high (place in text less place in
    item), or None beyond `most` edits. A row of the table holds the band only."""
    width, size, never = high - low + 1, len(text), np.int64(1) << 60
    step = np.int64(4 * (size + 2))
    padded = np.zeros(width + len(item) + 2, np.uint64)  # text[j] stands at j - low, zero outside
    a, b = max(0, low), min(size, low + len(padded))
    padded[a - low : max(a, b) - low] = text[a : max(a, b)]
    where = np.arange(width, dtype=np.int64)
    ramp = where * step
    j = where + low
    now = np.where((j >= 0) & (j <= size), size + 1 - j, never)
    for i, c in enumerate(item, 1):
        new = now + step * (padded[i - 1 : i - 1 + width] != c)
        np.minimum(new[:-1], now[1:] + step, out=new[:-1])
        j = where + (low + i)
        new[(j < 0) | (j > size)] = never
        new = np.minimum.accumulate(new - ramp) + ramp
        new[(j < 0) | (j > size)] = never
        now = new
        if now.min() >= (most + 1) * step:
            return None
    at = int(now.argmin())
    edits, rest = divmod(int(now[at]), int(step))
    return (edits, size + 1 - rest, at + low + len(item)) if edits <= most else None


class Items:
    """The q-gram index of a block of items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        kept = sorted(((i, t) for i, t in ((i, fold(t)) for i, t in rows) if t), key=lambda r: (r[0] is not None, r))
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.codes = [characters(t) for t in self.texts]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(n) for n in self.sizes], np.int64)
        q = np.minimum(Q, self.sizes // (self.edits + 1))
        self.least = self.sizes + 1 - q * (self.edits + 1)
        self.fine = [np.unique(grams(c, FINE), return_counts=True) for c in self.codes]
        self.least_fine = self.sizes + 1 - FINE * (self.edits + 1)
        #: Per gram length: hashes in order, their items and places, and which leading bits occur.
        self.classes = []
        for length in sorted(set(q.tolist())):
            own = np.flatnonzero(q == length)
            found = [grams(self.codes[k], length) for k in own]
            keys = np.concatenate(found)
            order = np.argsort(keys, kind="stable")
            item, place = np.repeat(own, [len(g) for g in found]), np.concatenate([np.arange(len(g)) for g in found])
            bits = np.zeros(1 << BITS, bool)
            bits[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.classes.append((length, keys[order], item[order], place[order], bits))

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of joined bands that hold enough distinct q-grams of the item."""
        fine = None
        for length, keys, items, places, bits in self.classes:
            g = grams(codes, length)
            at = np.flatnonzero(bits[(g >> np.uint64(64 - BITS)).astype(np.int64)])
            if not len(at):
                continue
            known, which, often = np.unique(g[at], return_inverse=True, return_counts=True)
            at = at[np.argsort(which, kind="stable")]
            begin = np.cumsum(often) - often  # of each gram's places among at
            lo, hi = np.searchsorted(keys, known, "left"), np.searchsorted(keys, known, "right")
            n = hi - lo
            if not n.sum():
                continue
            gram = np.repeat(np.arange(len(known)), n)
            hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, place = items[hit], places[hit]
            # an item whose grams in the whole text are too few, long or short ones, is out
            enough = np.bincount(item, minlength=len(self.sizes)) >= self.least
            for k in np.flatnonzero(enough).tolist():
                if self.edits[k]:
                    fine = np.unique(grams(codes, FINE)) if fine is None else fine
                    enough[k] = _shared(*self.fine[k], fine) >= self.least_fine[k]
            use = np.flatnonzero(enough[item])
            use = use[np.argsort(item[use], kind="stable")]
            ends = np.cumsum(often[gram[use]])
            first = 0
            while first < len(use):
                last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS)), first + 1)
                last = int(np.searchsorted(item[use], item[use[last - 1]], "right"))  # whole items
                yield from self._joined(item[use[first:last]], place[use[first:last]], gram[use[first:last]], at, begin, often, len(codes))
                first = last

    def _joined(self, item: np.ndarray, place: np.ndarray, gram: np.ndarray, at: np.ndarray, begin: np.ndarray, often: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        n = often[gram]
        where = at[np.repeat(begin[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        item, place = np.repeat(item, n), np.repeat(place, n)
        wide, most = self.edits[item] + 1, int(self.sizes.max()) + 1
        half = (where - place + most) // wide + 1
        span = int(half.max()) + 1
        # a diagonal lies in the band that begins at its half and in the one before
        code = np.unique(np.concatenate([(item * span + half) * most + place, (item * span + half - 1) * most + place])) // most
        code, count = np.unique(code, return_counts=True)
        code = code[count >= self.least[code // span]]
        if not len(code):
            return
        cut = np.flatnonzero(np.diff(code) > 2) + 1
        for run in np.split(code, cut):
            for part in np.split(run, np.flatnonzero(np.diff(run // span)) + 1):
                k, a = divmod(int(part[0]), span)
                b, e = int(part[-1]) % span, int(self.edits[k])
                low, high = (a - 1) * (e + 1) - most, (b + 1) * (e + 1) - 1 - most
                yield k, max(low - e, -e), min(high + e, size)

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of each item found, at its nearest place in the folded text."""
        folded = fold(text)
        codes, best = characters(folded), {}
        for k, low, high in self.bands(codes):
            e, size, item = int(self.edits[k]), int(self.sizes[k]), self.texts[k]
            if k in best and not best[k][0]:
                continue
            if not e:  # without edits an item has to stand between the ends of words
                if (at := _standing(folded, item, max(0, low), min(len(folded), high + size))) is not None:
                    best[k] = (0, at, at + size)
                continue
            a, b = max(0, low), min(len(folded), high + size + 1)
            at = folded.find(item, a, b)
            if at >= 0:
                found = (0, at, at + size)
            elif b - a < len(folded) // 2 and _shared(*self.fine[k], np.unique(grams(codes[a:b], FINE))) < self.least_fine[k]:
                continue
            else:
                found = align(self.codes[k], codes, low, high, e)
            if found and (k not in best or found[:2] < best[k][:2]):
                best[k] = found
        return [(self.ids[k], *v) for k, v in sorted(best.items())]


def _shared(own: np.ndarray, often: np.ndarray, there: np.ndarray) -> int:
    """How many places of own grams (with their counts) hold one of the sorted grams there."""
    if not len(there):
        return 0
    at = np.minimum(np.searchsorted(there, own), len(there) - 1)
    return int(often[there[at] == own].sum())


def _standing(text: str, item: str, a: int, b: int) -> int | None:
    """Where in text[a:b] the item stands with no letter or digit running on at either end."""
    at = text.find(item, a, b)
    while at >= 0:
        end = at + len(item)
        if not (at and text[at - 1].isalnum() and item[0].isalnum()) and not (end < len(text) and text[end].isalnum() and item[-1].isalnum()):
            return at
        at = text.find(item, at + 1, b)
    return None


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded block at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and item found in it: doc_id, item_id, edits, start, stop (characters of the folded text).

    An item may differ by edits of up to RATE of its characters; one that is too short for an edit (under 15) has to
    stand between the ends of words. Null and empty texts and items are found nowhere; repeated rows count as rows of
    their own, null ids stay null; other columns are ignored; no rows give no rows.
    """
    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, edits long, start long, stop long"
    out = None
    for held in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], held: list[tuple[int, str]] = held) -> Iterator[pa.RecordBatch]:
            index = Items(held)
            for batch in batches:
                found = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for x in index.search(t.as_py())]
                columns = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "start", "stop"])

        part = rows.mapInArrow(lean(run), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
