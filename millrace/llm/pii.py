"""Personal data: exact base patterns in one linear pass, and a semi-Markov conditional random field for the rest.

The field scores whole candidate segments (their digits, separators, check sums, ends and neighbours) and a dynamic
program over segments of bounded length chooses boundaries and kinds together. It runs in windows around triggers
that the base patterns left alone, and adds spans that overlap none of theirs: further spellings of the four base
kinds, and secrets (keys, tokens and passwords where they are given as such). It is trained here, on generated
sentences, by the likelihood of the right segmentation.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, spread

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the field knows; the base patterns have no secrets.
KINDS = (*BASE_KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9]([\x20().0-9-]+)")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str, runs: list[Span]) -> list[Span]:
    out, i = [], 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(e - s < 4000 and int(text[s:e]) <= 255 for s, e in four):
                out.append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return out


def cards(text: str, runs: list[Span]) -> list[Span]:
    out, i = [], 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        start, end = runs[i][0], runs[j][1]
        if 13 <= n <= 19 and luhn(re.sub("[ -]", "", text[start:end])):
            out.append((start, end))
        i = j + 1
    return out


def phones(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        nxt = at + 1
        if m:
            body = m[1].rstrip(" ().-")
            if len(body) >= 2:
                nxt = end = at + 2 + len(body)
                if 9 <= sum(c.isdigit() for c in text[at:end]) <= 15:
                    out.append((at, end))
        at = text.find("+", nxt)
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    runs = [m.span() for m in DIGITS.finditer(text)]
    return {"email": emails(text), "ip": ips(text, runs), "card": cards(text, runs), "phone": phones(text)}


# The field

#: Numbers, words, runs of letters and digits mixed, white space, marks.
TOKEN = re.compile(r"[0-9]++(?![^\W_])|[^\W\d_]++(?![0-9])|[^\W_]++|\s++|[^\w\s]|_")
TRIGGER = re.compile(r"[0-9][0-9 ()./-]{5,40}[0-9]|[\[(] ?at ?[\])]|@|(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{12,}|(?i:pass(?:word|wd)|secret|pwd)\b")
#: Tokens of a segment, characters read beside a trigger, tokens before a segment that may name it.
LONGEST, MARGIN, NAMED = 14, 32, 6
#: Words that a secret's name holds.
NAMES = frozenset(["token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "access"])


def features(tokens: list[str], i: int, j: int) -> list[float]:
    """Of the segment tokens[i:j] as a whole and of its neighbours."""
    part = tokens[i:j]
    text = "".join(part)
    groups = [t for t in part if t.isdigit()]
    digits = "".join(groups)
    n = len(digits)
    before, after = (tokens[i - 1] if i else " "), (tokens[j] if j < len(tokens) else " ")
    letters = any(t.isalpha() for t in part)
    at = "@" in part or ("at" in part and bool({"[", "("} & set(part)))
    solid = not any(t.isspace() for t in part) and text[0].isalnum() and text[-1].isalnum()
    mixed = any(len(t) > 3 and t.isalnum() and not t.isdigit() and not t.isalpha() for t in part)
    ahead = tokens[max(0, i - NAMED) : i]
    named = any(t.lower() in NAMES for t in ahead)
    given = named and any(t in "=:" for t in ahead[-4:])
    return [
        1.0,
        float(7 <= n <= 8),
        float(9 <= n <= 12),
        float(13 <= n <= 19),
        float(n < 7),
        float(n > 19),
        float(13 <= n <= 19 and luhn(digits)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(len(groups) == 1),
        float(letters),
        float(at),
        float(at and part[0].isalnum() and part[-1].isalpha() and ("." in part or "dot" in part)),
        float(part[0].isspace() or part[-1].isspace()),
        float(text[0] in "(+"),
        float(not text[-1].isalnum()),
        float(before[-1].isalnum() or before in "=-_\"'"),
        float(after[0].isalnum()),
        float("." in part),
        float("/" in part),
        float(len(part) == 1),
        float(given and solid),
        float(given and solid and len(text) >= 8),
        float(mixed),
        float(mixed and named and len(text) >= 12),
        float(mixed and not named),
        float(before in "\"'" and after in "\"'"),
        float(solid and text.isupper() and mixed and len(text) >= 16),
        float(at and bool(SPELLED.fullmatch(text))),
        float(n == 10 and bool(TEN.fullmatch(text))),
        float(after == "." and j + 1 < len(tokens) and tokens[j + 1].isalpha()),
        float(at and before in ".%+-_"),
    ]


N_FEATURES = 31
#: Whole shapes: an address with its mark spelled out, and ten digits of a phone number.
SPELLED = re.compile(r"[\w.%+-]+ ?[\[(] ?at ?[\])] ?[\w-]+(?: ?(?:\.|dot) ?[A-Za-z]+)+")
TEN = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")


def table(tokens: list[str]) -> np.ndarray:
    """(start, length - 1, feature); all zero for what is no candidate: past the end, or white space at an end."""
    out = np.zeros((len(tokens), LONGEST, N_FEATURES))
    blank = [t.isspace() for t in tokens]
    for i in range(len(tokens)):
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1 if not blank[i] else 0):
            if not blank[j - 1]:
                out[i, j - i - 1] = features(tokens, i, j)
    return out


def _scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = x @ w.T
    s[x[:, :, 0] == 0] = -1e9  # every candidate has the constant feature
    return s


def _sentence(rng: random.Random) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Tokens and the right segments (start, end, kind) of a generated sentence."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice([".", "/", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def local() -> str:
        return word() + rng.choice(["", "", f".{word()}", f"_{word()}", num(2)])

    def mixture(letters: str, n: int) -> str:
        while True:
            out = "".join(rng.choice(letters + "0123456789") for _ in range(n))
            if not out.isalpha() and not out.isdigit():
                return out

    hexadecimal, letters = "abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def secret() -> str:
        return rng.choice(
            [
                lambda: mixture(hexadecimal, rng.choice([24, 32, 40, 64])),
                lambda: mixture(letters, rng.randint(14, 48)),
                lambda: mixture(letters, rng.randint(8, 13)),
                lambda: f"{mixture(letters, 8)}-{mixture(letters, 12)}",
            ]
        )()

    def given() -> tuple[str, str, str]:
        name = rng.choice(["token", "key", "api_key", "secret", "password", "passwd", "pwd", "access_token", "API key", "Auth token", "Password"])
        sign, quote = rng.choice([" = ", "=", ": ", " : "]), rng.choice(['"', "'", "", ""])
        return name + sign + quote, secret(), quote

    makers = [
        lambda: (0, f"{local()} {rng.choice(['[at]', '(at)'])} {word()}.{rng.choice(['com', 'org', 'net'])}"),
        lambda: (0, f"{local()}[at]{word()} dot com"),
        lambda: (1, " . ".join(str(rng.randint(0, 255)) for _ in range(4))),
        lambda: (2, card()),
        lambda: (3, f"({num(3)}) {num(3)}-{num(4)}"),
        lambda: (3, f"{num(3)}-{num(3)}-{num(4)}"),
        lambda: (3, f"{num(3)}.{num(3)}.{num(4)}"),
        lambda: (4, given()),
        lambda: (4, given()),
        lambda: (4, ("", "AKIA" + mixture("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16), "")),
        lambda: (None, f"{rng.choice(['commit', 'revision', 'digest', 'id', 'see'])} {mixture(hexadecimal, rng.choice([12, 16, 32, 40]))}"),
        lambda: (None, f"{rng.choice(['token', 'key', 'password', 'secret'])} {rng.choice([word(), num(2), ':', 'of ' + word()])}"),
        lambda: (None, f"{rng.choice(['size', 'color', word()])} = {rng.choice([word(), num(3), mixture(hexadecimal, 12)])}"),
        lambda: (None, f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        lambda: (None, num(rng.choice([6, 8, 12, 16, 20, 24]))),
        lambda: (None, f"{rng.randint(1, 20)}.{num(1)}.{num(2)}"),
        lambda: (None, f"{word()} (at) the {word()}"),
        lambda: (None, f"{num(3)} {num(2)} {num(4)} {num(2)}"),
    ]
    tokens, gold = [], []
    for _ in range(rng.randint(1, 2)):
        tokens += TOKEN.findall(" ".join(word() for _ in range(rng.randint(1, 4))) + " ")
        kind, text = rng.choice(makers)()
        closing = ""
        if isinstance(text, tuple):
            opening, text, closing = text
            tokens += TOKEN.findall(opening)
        part = TOKEN.findall(text)
        if kind is not None and len(part) <= LONGEST:
            gold.append((len(tokens), len(tokens) + len(part), kind))
        tokens += part + TOKEN.findall(closing + rng.choice([" ", ". ", ", ", " "]) + word())
        tokens.append(" ")
    return tokens, gold


@lru_cache(1)
def train(sentences: int = 500, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Weights (kind, feature) by stochastic ascent of the segmentations' log-likelihood. Other tokens score 0."""
    rng = random.Random(seed)
    data = [(table(t), g) for t, g in (_sentence(rng) for _ in range(sentences))]
    w = np.zeros((len(KINDS), N_FEATURES))
    for epoch in range(epochs):
        for x, gold in data:
            n, s = len(x), _scores(x, w)
            total = np.logaddexp.reduce(s, axis=2)
            ahead, back = np.full(n + 1, -1e18), np.full(n + 1, -1e18)
            ahead[0] = back[n] = 0.0
            for i in range(n):
                m = min(LONGEST, n - i)
                reach = ahead[i] + total[i, :m]
                reach[0] = np.logaddexp(reach[0], ahead[i])
                ahead[i + 1 : i + 1 + m] = np.logaddexp(ahead[i + 1 : i + 1 + m], reach)
            for i in range(n - 1, -1, -1):
                m = min(LONGEST, n - i)
                reach = back[i + 1 : i + 1 + m] + total[i, :m]
                back[i] = np.logaddexp(np.logaddexp.reduce(reach), back[i + 1])
            ends = np.minimum(np.add.outer(np.arange(n), np.arange(1, LONGEST + 1)), n)
            p = np.exp(np.minimum(0, ahead[:n, None, None] + s + back[ends][:, :, None] - ahead[n]))
            gradient = -np.einsum("ilk,ilf->kf", p, x)
            for i, j, k in gold:
                gradient[k] += x[i, j - i - 1]
            w += 0.1 / (1 + epoch / 4) * (gradient - 1e-3 * w)
    return w


def decode(tokens: list[str], w: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation: (start, end, kind) of its entities."""
    n = len(tokens)
    s = _scores(table(tokens), w)
    kind, score = s.argmax(axis=2), s.max(axis=2)
    best, choice = np.zeros(n + 1), [(1, -1)] * n
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        for m in range(min(LONGEST, n - i)):
            if score[i, m] + best[i + 1 + m] > best[i]:
                best[i], choice[i] = score[i, m] + best[i + 1 + m], (m + 1, int(kind[i, m]))
    out, i = [], 0
    while i < n:
        m, k = choice[i]
        if k >= 0:
            out.append((i, i + m, k))
        i += m
    return out


def field_spans(text: str, taken: list[Span], w: np.ndarray) -> dict[str, list[Span]]:
    """Spans that the field finds around triggers and that touch no taken span."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    edge = 0
    for first, after in [*sorted(taken), (len(text), len(text))]:
        done, hit = edge, TRIGGER.search(text, edge, first)
        while hit:
            lo, hi = max(done, hit.start() - MARGIN), min(first, hit.end() + MARGIN)
            spots = [t.span() for t in TOKEN.finditer(text, lo, hi)]
            at = hit.end()
            for i, j, k in decode([text[a:b] for a, b in spots], w):
                start, end = spots[i][0], spots[j - 1][1]
                whole = not (start == lo and lo and text[lo - 1].isalnum() and text[lo].isalnum()) and not (end == hi < len(text) and text[hi].isalnum())
                if whole and start >= done:
                    out[KINDS[k]].append((start, end))
                    done = end
            done = at = max(done, at)
            hit = TRIGGER.search(text, at, first)
        edge = max(edge, after)
    return out


def find(text: str | None, w: np.ndarray) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base and added spans together, per kind."""
    base = base_spans(text or "") | {"secret": []}
    more = field_spans(text or "", [s for k in KINDS for s in base[k]], w)
    return base, {k: sorted(base[k] + more[k]) for k in KINDS}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span, or union of spans that overlap, replaced by <KIND>."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_<kind> of base spans, base_sha256, spans, n_spans (all), redacted.

    Without `redacted` that column is null. Null texts are empty; repeated rows are rows of their own; null ids stay null; other columns are ignored;
    no rows give no rows. Offsets are code points, ends exclusive.
    """
    w = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans, all_, clean = [[] for _ in BASE_KINDS], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base, found = find(text, w)
                for c, k in zip(counts, BASE_KINDS):
                    c.append(len(base[k]))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
                all_.append(sum(map(len, found.values())))
                clean.append(redact(text, found) if redacted else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (digest, spans)), pa.array(all_, pa.int64()), pa.array(clean, pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans", "redacted"],
            )

    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string"
    return rows.mapInArrow(lean(run), schema)


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its text redacted; every other column and null texts stay as they are."""
    w = train()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t.as_py() is None else redact(t.as_py(), find(t.as_py(), w)[1]) for t in batch.column(at)]
            columns = [pa.array(clean, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return spread(docs).mapInArrow(lean(run), docs.schema)
