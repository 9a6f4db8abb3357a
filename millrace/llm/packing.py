"""Best-fit packing of token sequences under several capacities at once.

What a piece needs depends on its length alone, so the packing is solved on the histogram of lengths, which
has at most as many rows as a sequence has tokens, however large the corpus is. Bins of equal content are one
group with a count. Each length, longest first, goes to the open group that scores best among those with room
under every capacity; pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import gapless_rank, lean, materialize, spread

#: Byte that ends a word in the merge table; it never occurs in UTF-8 text.
WORD_END = b"\xff"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


class WordTokenizer:
    """ids of a word-level BPE file as little-endian 32-bit bytes, by a bounded memo of words.

    Plain texts are lower-cased and split as the file says; no merge crosses a split, so a word's ids are
    always the same. The merges of a new word run in a rank table. Texts with other characters, or with the
    strings of special tokens, go whole to the tokenizers library.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        byte = {c: bytes([b]) for b, c in char.items()}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in SPECIAL:
                ranks[b"".join(byte[c] for c in token.removesuffix("</w>")) + WORD_END * token.endswith("</w>")] = i
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.split = regex.compile(rf"{short}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+").findall
        letters, digits = ("".join(c for c in map(chr, range(128, 256)) if unicodedata.category(c)[0] == k) for k in "LN")
        self.split_latin = re.compile(rf"[a-z{letters}]+|{short}|[0-9{digits}]|[^\sa-z{letters}0-9{digits}]+").findall
        self.odd = re.compile("[İɐ-\U0010ffff]").search

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                ids = core.encode_single_piece(word.encode() + WORD_END)
                out = struct.pack(f"<{len(ids)}I", *ids)
                if len(word) <= 64:
                    if len(self) >= most:
                        self.clear()
                    self[word] = out
                return out

        self.memo = Memo()

    def splitter(self, text: str) -> Callable[[str], list[str]] | None:
        """What splits the text as the file says; None if only the library can tell."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or "<|" in text and any(s in text for s in SPECIAL):
            return None
        try:
            text.encode("latin-1")
            return self.split_latin
        except UnicodeEncodeError:
            return None if self.odd(text) or not unicodedata.is_normalized("NFC", text) else self.split

    def __call__(self, text: str) -> bytes:
        if split := self.splitter(text):
            return b"".join(map(self.memo.__getitem__, split(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]


def token_pieces(docs: DataFrame, path: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and an id 0, cut into pieces of at most `most` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "") + bytes(4)
                for at in range(0, len(ids), 4 * most):
                    part = ids[at : at + 4 * most]
                    for column, value in zip(out, (doc, at // (4 * most), at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(cut), "doc_id long, piece long, start long, length long, ids_crc32 long")


def pack_histogram(
    counts: dict[int, int], tokens: int, documents: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal bins: (bins, [(length, copies), ...]).

    A bin holds at most `tokens` tokens, `documents` pieces and a sum of squared lengths of `attention`.
    rule "norm" takes the bin whose weighted residual, after the piece is in, has the smallest norm; "dot"
    the bin whose residual has the largest weighted dot product with the piece.
    """
    caps, w = np.array([tokens, documents, attention], float), np.array(weights)
    left = np.zeros((0, 3), np.int64)
    bins = np.zeros(0, np.int64)
    items: list[list[tuple[int, int]]] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []
    for length in sorted(counts, reverse=True):
        need, n = np.array([length, 1, length * length]), counts[length]
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while n:
            fit = np.flatnonzero((left >= need).all(axis=1)) if len(bins) else []
            if not len(fit):
                k = int(min(tokens // length, documents, attention // (length * length)))
                grown = [(n // k, k), (1, n % k)]
                new = [(m, [tokens, documents, attention] - need * c, [(length, c)]) for m, c in grown if m and c]
                n = 0
            else:
                if rule == "norm":
                    score = -np.linalg.norm((left[fit] - need) / caps * w, axis=1)
                else:
                    score = (left[fit] / caps * w * (need / caps)).sum(axis=1)
                g = int(fit[np.argmax(score)])
                k, m, was = int((left[g] // need).min()), int(bins[g]), left[g].copy()
                full = min(m, n // k)
                rest = n % k if full < m else 0
                new = [(b, was - need * c, items[g] + [(length, c)] * (c > 0)) for b, c in ((full, k), (int(rest > 0), rest), (m - full - int(rest > 0), 0)) if b]
                n -= full * k + rest
                keep = np.arange(len(bins)) != g
                left, bins, items = left[keep], bins[keep], items[:g] + items[g + 1 :]
            for b, r, content in new:
                if r[0] and r[1] and r[2]:
                    left, bins = np.vstack([left, r]), np.append(bins, b)
                    items.append(content)
                else:
                    done.append((b, content))
    return done + [(int(b), content) for b, content in zip(bins, items)]


def pack(
    docs: DataFrame,
    path: str,
    tokens: int = 2048,
    documents: int = 256,
    attention: int = 2048 * 2048,
    rule: str = "norm",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence holds at most `tokens` tokens, `documents` pieces and a sum of squared lengths of `attention`, which has
    to allow a whole piece. Where one piece may fill a sequence, the sum of squares is largest for that piece, so that
    capacity steers the choice by its residual and binds only if `attention` is below the square of `tokens`, which
    texts of that length then fit no more; `documents` binds where texts are short.

    Only texts longer than a sequence are cut. Null and empty texts are one piece, the closing id alone; equal
    rows are pieces of their own; null ids stay null; no rows give no rows. Other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, path, tokens, id_col, text_col), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most `tokens` rows
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, content in pack_histogram(counts, tokens, documents, attention, rule):
        offset = 0
        for length, copies in content:
            rows.append((length, used[length], used[length] + bins * copies, copies, sequence, offset))
            used[length] += bins * copies
            offset += length * copies
        sequence += bins
    places = docs.sparkSession.createDataFrame(rows, "_length long, _from long, _to long, _copies long, _sequence long, _offset long")
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "start"], sum(counts.values()), "_rank")
    at = F.col("_rank") - F.col("_from")
    placed = ranked.join(
        F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    )
    return placed.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        "start",
        "length",
        "ids_crc32",
        (F.col("_sequence") + F.floor(at / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_copies")) * F.col("length")).cast("long").alias("offset"),
    )
