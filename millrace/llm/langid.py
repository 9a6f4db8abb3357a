"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

Texts are cut into windows of WINDOW bytes that run side by side, so a step of the recurrence is one small matrix
product over thousands of windows. Each window is read with CONTEXT bytes of its neighbours on both sides, so that
the states of both directions are warm where its own bytes begin. Every byte gets a distribution over the languages;
a document's is the mean over the bytes of its letters. Gates use x / (1 + |x|) in place of the logistic, which bounds them alike at a lower cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import lean, spread

WINDOW, CONTEXT, HIDDEN = 96, 16, 8
#: Labelled rows of each language that training takes at most, and the windows drawn from all over each of them.
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 4


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def init(n_langs: int, seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {"out": r.normal(0, 0.3, (n_langs, 2 * HIDDEN)), "bias": np.zeros((n_langs, 1))}
    for d in "fb":
        w[f"emb_{d}"] = r.normal(0, 0.5, (256, 3 * HIDDEN))
        w[f"rec_{d}"] = r.normal(0, 0.4, (3 * HIDDEN, HIDDEN))
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_one_way(w: dict[str, np.ndarray], d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """x: (steps, windows) bytes in the order of this direction; the states (steps, HIDDEN, windows)."""
    h = np.zeros((HIDDEN, x.shape[1]), np.float32)
    states = np.empty((len(x), HIDDEN, x.shape[1]), np.float32)
    table, rec, gates = np.ascontiguousarray(w[f"emb_{d}"].T), w[f"rec_{d}"], 2 * HIDDEN
    for t in range(len(x)):
        e = table[:, x[t]]
        a = rec[:gates] @ h
        a += e[:gates]
        g = 0.5 * soft(a) + 0.5
        z, r = g[:HIDDEN], g[HIDDEN:]
        c_in = rec[gates:] @ (r * h)
        c_in += e[gates:]
        c = soft(c_in)
        new = h + z * (c - h)
        if keep is not None:
            keep.append((h, a, z, r, c_in, c))
        states[t] = h = new
    return states


def probabilities(w: dict[str, np.ndarray], x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(steps, languages, windows): the label distribution of every byte."""
    f = run_one_way(w, "f", x, None if keep is None else keep.setdefault("f", []))
    b = run_one_way(w, "b", x[::-1], None if keep is None else keep.setdefault("b", []))[::-1]
    s = w["out"][:, :HIDDEN] @ f
    s += w["out"][:, HIDDEN:] @ b
    s += w["bias"]
    s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=1, keepdims=True)
    if keep is not None:
        keep["states"] = (f, b)
    return s


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients by backpropagation through time. y: label per window; use: (steps, windows) weights."""
    keep: dict = {}
    p = probabilities(w, x, keep)
    cols = np.arange(x.shape[1])
    total = use.sum() + 1e-9
    loss = -(np.log(p[:, y, cols] + 1e-12) * use).sum() / total
    ds = p.copy()
    ds[:, y, cols] -= 1
    ds *= (use / total)[:, None, :]
    f, b = keep["states"]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["bias"] = ds.sum(axis=(0, 2))[:, None]
    g["out"] = np.concatenate([np.einsum("tlb,thb->lh", ds, f), np.einsum("tlb,thb->lh", ds, b)], axis=1)
    for d, part, order in (("f", w["out"][:, :HIDDEN], 1), ("b", w["out"][:, HIDDEN:], -1)):
        dh_out = (part.T @ ds)[::order]
        xs, rec, gates = x[::order], w[f"rec_{d}"], 2 * HIDDEN
        dh = np.zeros_like(keep[d][0][0])
        for t in range(len(xs) - 1, -1, -1):
            h, a, z, r, c_in, c = keep[d][t]
            dh = dh + dh_out[t]
            dc = dh * z / (1 + np.abs(c_in)) ** 2
            drh = rec[gates:].T @ dc
            da = np.concatenate([dh * (c - h), drh * h]) * 0.5 / (1 + np.abs(a)) ** 2
            g[f"rec_{d}"][gates:] += dc @ (r * h).T
            g[f"rec_{d}"][:gates] += da @ h.T
            np.add.at(g[f"emb_{d}"], xs[t], np.concatenate([da, dc]).T)
            dh = dh * (1 - z) + drh * r + rec[:gates].T @ da
    return float(loss), g


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(CONTEXT + WINDOW + CONTEXT, n) bytes and the text of each window; zero bytes stand beyond a text's ends."""
    sizes = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    edge = bytes(CONTEXT)
    flat = np.frombuffer(b"".join(edge + t.ljust(n * WINDOW, b"\0") + edge for t, n in zip(texts, sizes.tolist())), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes * WINDOW + 2 * CONTEXT) - (sizes * WINDOW + 2 * CONTEXT)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = begin[owner] + inside * WINDOW
    return flat[np.arange(WINDOW + 2 * CONTEXT)[:, None] + at[None, :]] if len(at) else np.zeros((WINDOW + 2 * CONTEXT, 0), np.uint8), owner


LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)], np.float32)


def own_bytes(use: np.ndarray) -> np.ndarray:
    """Weights of a window's bytes without those of its neighbours."""
    use = use.copy()
    use[:CONTEXT] = use[CONTEXT + WINDOW :] = 0
    return use


def fit(samples: list[tuple[str, str]], epochs: int = 10, rate: float = 0.02, seed: int = 3) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and weights from (text, language), by Adam over mini-batches of windows."""
    langs = sorted({lang for _, lang in samples})
    x, owner = windows([t.encode("utf-8", "replace") for t, _ in samples])
    y = np.array([langs.index(lang) for _, lang in samples])[owner]
    use, w, r = own_bytes(LETTER[x]), init(len(langs), seed), np.random.default_rng(seed)
    share = np.bincount(y, minlength=len(langs)) / len(y)
    use = use * (1 / (len(langs) * np.maximum(share, 1e-6)))[y].astype(np.float32) ** 0.5
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        for part in np.array_split(r.permutation(len(y)), max(1, len(y) // 512)):
            _, g = gradients(w, x[:, part], y[part], use[:, part])
            step += 1
            for k in w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                w[k] -= (rate / (1 + epoch / 4)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return langs, w


def predict(langs: list[str], w: dict[str, np.ndarray], texts: list[str | None], most: int = 4096) -> list[tuple[str, float]]:
    """(language, probability) of each whole text; ("und", 0.0) without a letter."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    total, weight = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    x, owner = windows(raw)
    for at in range(0, len(owner), most):
        part, who = x[:, at : at + most], owner[at : at + most]
        use = own_bytes(LETTER[part])
        p = np.einsum("tlb,tb->bl", probabilities(w, part), use)
        for k in range(len(langs)):
            total[:, k] += np.bincount(who, p[:, k], len(texts))
        weight += np.bincount(who, use.sum(axis=0), len(texts))
    out = []
    for t, n, row in zip(texts, weight, total):
        if not n or not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0))
        else:
            k = int(row.argmax())
            out.append((langs[k], float(min(1.0, row[k] / n))))
    return out


def sample(docs: DataFrame, allowed: object, most: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(text, language) of windows from at most `most` labelled rows of each language, those of the smallest hashes.

    The windows' places are drawn by hash over the whole text. A cut by hash per language leaves about four times as
    many rows before the sort, so few rows move, whatever their number, and of them the windows only. A row per
    language is broadcast; there are as many as the model has outputs.
    """
    labelled = docs.where(allowed).where("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    cut = F.when(F.col("n") <= 4 * most, F.lit(2**63 - 1)).otherwise(((4.0 * most / F.col("n") - 0.5) * 2.0**64).cast("long"))
    cuts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("_lang"), cut.alias("cut"))
    wide = WINDOW + 2 * CONTEXT
    room = F.greatest(F.length("text") - wide, F.lit(0)) + 1
    drawn = F.transform(F.array(*[F.lit(k) for k in range(SAMPLE_WINDOWS)]), lambda k: F.substring("text", (F.pmod(F.xxhash64("h", k), room) + 1).cast("int"), F.lit(wide)))
    few = labelled.join(F.broadcast(cuts), F.col("lang") == F.col("_lang")).where("h <= cut").select("lang", "h", F.array_distinct(drawn).alias("parts"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "parts"))
    found = few.withColumn("r", first).where(F.col("r") <= most).select("lang", "h", F.explode("parts").alias("part")).orderBy("lang", "h", "part").collect()
    return [(r["part"], r["lang"]) for r in found]


def held_out() -> object:
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2


def learn(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """A model from a bounded sample of the rows that aren't held out; without languages if there is none to learn."""
    rows = sample(docs, ~F.coalesce(held_out(), F.lit(False)))
    return fit(rows) if rows else ([], {})


def judge(model: tuple[list[str], dict[str, np.ndarray]], texts: list[str | None]) -> list[tuple[str, float]]:
    langs, w = model
    return predict(langs, w, texts) if langs else [("und", 0.0)] * len(texts)


def identify(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """docs (doc_id, text, lang) to (doc_id, held_out, lang_pred, score), a row per row.

    Without a model one is trained on a bounded sample of the rows that aren't held out. "und" stands for null
    texts and those without a letter, and for all rows if none has a language to learn. Extra columns are ignored.
    """
    model = model or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = judge(model, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, least: float, model: tuple[list[str], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that have a language with a probability of `least` or more.

    Each row is judged where it lies, by its text alone: ids may be null or repeat. Null texts and those without
    a letter go; no rows give no rows.
    """
    model = model or learn(docs)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = judge(model, part.column(text).to_pylist())
                yield part.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return spread(docs).mapInArrow(lean(run), docs.schema)
