"""Each operator against brute force on small tables, and its edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, decontam, embed_dedup, langid, license_scan, minhash, packing, pii, shard, substring

DOC = "doc_id long, text string, lang string, source string"
R = random.Random(8)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def documents(spark):
    a, shared = prose(120), prose(60)
    near = a.split()
    near[50] = "changed"
    texts = [a, a, " ".join(near), prose(80) + " " + shared, shared + "\n" + prose(90), None, "", "one", "one", "a " * 80, "x" * 30_000, prose(5000), "ÉÈ ü"]
    return spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], DOC), texts


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_minhash(spark):
    df, texts = documents(spark)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j, u in enumerate(sets):
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    got = collect(minhash.near_duplicates(df))
    assert [got[i]["component_id"] for i in range(len(texts))] == group
    assert [got[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_large_buckets(spark, monkeypatch):
    """Chains of near copies beside documents that share most of a passage, in blocks of three rows."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    shared, texts = prose(200), []
    for k in range(12):
        own = shared.split() + prose(20 + 9 * k).split()
        for step in range(3):
            texts.append(" ".join(own[: len(own) - 4 * step]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j, u in enumerate(sets):
            if 100 * len(s & u) >= 75 * len(s | u):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    df = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], DOC)
    got = collect(minhash.near_duplicates(df))
    assert [got[i]["component_id"] for i in range(len(texts))] == group

    # the block path alone: every document of its own component, in one bucket
    many = spark.createDataFrame([(1, i, i, len(s)) for i, s in enumerate(sets)], "band long, rep long, c long, n long")
    full = minhash.set_rows(df.select(F.col("doc_id").alias("rep"), "text"), 5)
    links = {(r.a, r.b) for r in minhash.open_links(many, full, 75).collect()}
    found = list(range(len(texts)))
    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
        found = [min(found[a], found[b]) if g in (found[a], found[b]) else g for g in found]
    assert found == group


def test_substring(spark):
    df, texts = documents(spark)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    got = collect(substring.remove_repeats(df))
    for i, w in enumerate(words):
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_cover():
    for i in range(21):
        for j in range(21):
            assert any((i + k) % 21 in substring.COVER and (j + k) % 21 in substring.COVER for k in range(21))


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(30, 16))
    v = np.concatenate([base, base[:10] + r.normal(size=(10, 16)) * 0.05, base[:5]])
    rows = [(i, [float(x) for x in e], i % 3 if i < 40 else (i - 40) % 3) for i, e in enumerate(v)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, rows[0][1], None), (104, [], 1)]
    got = collect(embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "vec_id")
    u = np.stack([np.float32(e).astype(float) for _, e, _ in rows[:45]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([x[2] for x in rows[:45]])
    hit = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :]) & ~np.eye(45, dtype=bool)
    assert hit.sum() > 0
    assert [got[i]["n_links"] for i in range(45)] == hit.sum(axis=1).tolist()
    for i in range(45):
        assert got[i]["component_id"] == min([i, *np.flatnonzero(hit[i])]) or hit[i].sum() > 1
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(100, 105))


def test_embedding_codes():
    """The estimate is unbiased, no planted pair is lost by the bound, and few pairs are computed again."""
    r = np.random.default_rng(4)
    base = r.normal(size=(400, 64))
    v = embed_dedup.unit(np.concatenate([base, base + r.normal(size=base.shape) * 0.15]))
    turns = embed_dedup.rotations(64, 2)
    _, code, factor, coordinates, step = embed_dedup.encode(v, turns, 8, 16)
    every = np.arange(len(v))
    signs = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    error = signs @ (coordinates * step[:, None]).T / 8 / factor[:, None] - v @ v.T
    assert abs(error[~np.eye(len(v), dtype=bool)].mean()) < 2e-3
    i, j = embed_dedup.open_pairs(code, factor, coordinates, step, every, every, 0.98)
    want = {(int(a), int(b)) for a, b in np.argwhere(v @ v.T >= 0.98)}
    assert len(want) > 1000 and want <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 0.01 * len(v) ** 2


def test_embeddings_in_blocks(spark, monkeypatch):
    """A dense group in blocks of a few rows, with null and repeated ids, against brute force."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    r = np.random.default_rng(6)
    base = r.normal(size=(3, 16))
    v = np.float32(np.concatenate([base[k] + r.normal(size=(25, 16)) * 0.12 for k in range(3)] + [base[:1]] * 30))
    ids = [None if k % 11 == 3 else k // 2 for k in range(len(v))]
    df = spark.createDataFrame([(i, [float(x) for x in e], "x") for i, e in zip(ids, v)], "vec_id long, embedding array<float>, label string")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect())
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & ~np.eye(len(v), dtype=bool)
    group = list(range(len(v)))
    for a, b in np.argwhere(hit):
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    least = {g: min([i for i, h in zip(ids, group) if h == g and i is not None], default=None) for g in group}
    assert got == Counter((i, int(n), least[g]) for i, n, g in zip(ids, hit.sum(axis=1), group))


def test_license():
    i = license_scan.Index().weigh(10, {b"the": 9})
    got = i.scan("Released UNDER the MIT License. Licensed under CC BY-NC 4.0.")
    assert got[:5] == (12, 2, 1, 7, "cc-by-nc,mit")
    assert i.scan(None) == (0, 0, None, None, "", "", 0.0)
    assert i.scan("This work is licensed under the GNU General Public License, version 3.")[5] == "gpl-3"


def test_license_base_columns_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = collect(license_scan.scan_licenses(docs))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    hits = 0
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in phrases.items()}
        every = sorted(sum(at.values(), []))
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(words), len(every), every[0] if every else None, every[-1] if every else None)
        assert g["base_labels"] == ",".join(sorted(k for k, v in at.items() if v)) and set(g["base_labels"].split(",")) - {""} <= set(g["labels"].split(","))
        hits += len(every)
    assert hits


def test_pii_base_columns_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = collect(pii.find_pii(docs))
    for r in docs.collect():
        t, g = r["text"] or "", got[r["doc_id"]]
        base = plain_base(t)
        assert [g[f"n_{k}"] for k in base] == [len(v) for v in base.values()]
        assert g["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, v in base.items() for a, b in v).encode()).hexdigest()
        every = g["spans"].split(",") if g["spans"] else []
        assert {f"{k}:{a}:{b}" for k, v in base.items() for a, b in v} <= set(every) and g["n_spans"] == len(every)


def test_license_table(spark):
    df, texts = documents(spark)
    got = collect(license_scan.scan_licenses(df))
    assert len(got) == len(texts) and got[7]["n_words"] == 1
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_tokens_and_packing(spark):
    df, texts = documents(spark)
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    t = packing.tokenizer(path)
    more = ["don't I'LL x's", "œuvre “q”", "İ <|endoftext|> a", "a\x1cb", "½ ² 12", "é"]
    for x in [t_ or "" for t_ in texts] + more:
        assert np.frombuffer(t(x), "<u4").tolist() == t.whole.encode(x, add_special_tokens=False).ids
    for rule in ("norm", "dot"):
        rows = packing.pack(df, path, 256, 20, 256 * 256, rule).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for b in bins.values():
            end = 0
            for o, n in sorted(b):
                assert o == end
                end += n
            assert end <= 256 and len(b) <= 20
        assert Counter(r["doc_id"] for r in rows).keys() == set(range(len(texts)))
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_against_the_lower_bound(spark):
    """Pieces are what the tokenizer gives; sequences are few; every capacity can bind and does."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    whole, got = packing.tokenizer(path).whole, packing.pack(docs, path).collect()
    want = set()
    for d, t in texts.items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)}
    assert {tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)
    fewest = -(-sum(w[3] for w in want) // 2048)
    assert len({r["sequence_id"] for r in got}) <= 1.02 * fewest + 1
    counts = {1: 1000, 10: 300, 700: 40}
    for documents, attention in ((256, 2048**2), (20, 2048**2), (256, 10**6)):
        for rule in ("norm", "dot"):
            bins = packing.pack_histogram(dict(counts), 2048, documents, attention, rule)
            for n, held in bins:
                assert sum(k * c for k, c in held) <= 2048 and sum(c for _, c in held) <= documents and sum(k * k * c for k, c in held) <= attention
            assert all(sum(n * c for n, held in bins for k, c in held if k == size) == often for size, often in counts.items())
            made = sum(n for n, _ in bins)
            assert made >= max(-(-sum(counts.values()) // documents), 20 if attention == 2048**2 else 20)
            assert made <= {256: 22, 20: 72}[documents]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    """The base patterns as they are given."""
    bare = lambda m: re.sub("[ -]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(bare(m)) <= 19 and pii.luhn(bare(m))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15],
    }


def test_pii_base():
    for _ in range(5000):
        t = "".join(R.choice(["a", "@", ".", "b.c", "1", "23", "255", "300", " ", "-", "+", "(", ")", "4012888888881881", "x@y.z"]) for _ in range(R.randint(1, 24)))
        assert pii.base_spans(t) == plain_base(t)


def test_pii_field():
    w, r = pii.train(), random.Random(77)
    right = total = wrong = 0
    for _ in range(150):
        tokens, gold = pii._sentence(r)
        got = set(pii.decode(tokens, w))
        right, total, wrong = right + len(got & set(gold)), total + len(gold), wrong + len(got - set(gold))
    assert right > 0.9 * total and wrong < 0.1 * total
    base, found = pii.find("mail a@b.cc now", w)
    assert pii.redact("mail a@b.cc now", found) == "mail <EMAIL> now"


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\<b", "", None, "<|user|>\n"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)] + [(2, 0, "assistant", "x"), (3, 0, None, "y")]
    rows += [(4, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(400)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = collect(chat.digest_rows(out), "conv_id")
    for c in (1, 2, 3, 4):
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [False, False, False, True]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_shard(spark):
    df = spark.createDataFrame([(i if i % 50 else None, "é" * (i % 7)) for i in range(1000)], "doc_id long, text string")
    rows = shard.shard_rows(df, 7).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert shard.shard_rows(df.limit(0), 7).count() == 0


def test_shard_columns_and_law(spark):
    """Size and check sum of every text, hot ids and rows dealt over partitions, and draws of the law's mean and spread."""
    texts = [None, "", "a", "héé", "x" * 5000] * 40
    df = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = shard.shard_rows(df, 6).collect()
    want = Counter((None if i % 3 else 7, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    draws = np.array([shard.communication_matrix([30, 50, 20], [40, 60], s)[0][0] for s in range(3000)])
    assert abs(draws.mean() - 12) < 0.2 and abs(draws.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.6


def test_hypergeometric_beyond_numpy():
    r = np.random.default_rng(2)
    x = [shard.hypergeometric(r, 10**9, 3 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(x) - 250_000) < 200 and 300 < np.std(x) < 600
    m = shard.communication_matrix([5, 0, 9], [5, 5, 4], 1)
    assert [sum(row) for row in m] == [5, 0, 9] and [sum(c) for c in zip(*m)] == [5, 5, 4]


def nearest(item, text):
    """Edits of the part of text nearest to item, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontam(spark):
    items = [(1, prose(30)), (2, prose(40)), (3, "short"), (4, None)]
    changed = list(items[1][1])
    changed[20], changed[60] = "#", "#"
    texts = [prose(50), prose(20) + " " + items[0][1].upper() + " " + prose(9), prose(30) + " " + "".join(changed) + prose(10), None, "", "a short one", "shorter"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 0), (2, 2, 2), (5, 3, 0)}
    assert decontam.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontam_against_every_distance():
    """Items of all sizes, edited by up to two more than their budget, in Latin and Cyrillic letters."""
    r = random.Random(31)
    for alphabet in ("abc de", "\u0431\u0432\u0433 \u0434\u0436"):
        items = [decontam.fold("".join(r.choice(alphabet) for _ in range(n))) for n in [15, 16, 18, 22, 28, 29, 30, 44, 60, 75, 90] * 4]
        items = [t for t in items if len(t) >= 15]
        index = decontam.Items(list(enumerate(items)))
        hits = 0
        for item in items:
            part = list(item)
            for _ in range(r.randint(0, decontam.budget(len(item)) + 2)):
                at = r.randrange(len(part))
                part[at : at + 1] = r.choice([[], [r.choice("xyz")], [part[at], "q"]])
            text = decontam.fold("".join(r.choice(alphabet) for _ in range(80)) + "".join(part) + "".join(r.choice(alphabet) for _ in range(60)))
            got = {k: (e, a, b) for k, e, a, b in index.search(text)}
            want = {k: d for k, t in enumerate(items) if (d := nearest(t, text)) <= decontam.budget(len(t))}
            assert {k: v[0] for k, v in got.items()} == want
            for k, (e, a, b) in got.items():
                assert nearest(items[k], text[a:b]) == e
            hits += len(got)
        assert hits > 20


def test_decontam_repeated_phrase():
    """A text that repeats what many items hold."""
    r = random.Random(5)
    phrase = "the quick brown fox jumps over "
    items = [phrase + "".join(r.choice("abcdefgh ") for _ in range(90)) for _ in range(500)]
    began = time.time()
    index = decontam.Items(list(enumerate(items)))
    assert index.search(phrase * 100) == [] and len(index.search(phrase * 100 + items[7])) == 1
    assert time.time() - began < 10


def test_langid():
    def text(vocabulary, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(40))

    a, b = ["the", "and", "thing", "with"], ["der", "und", "nicht", "schön"]
    model = langid.fit([(text(v, s), n) for s in range(60) for v, n in ((a, "en"), (b, "de"))], epochs=8)
    got = langid.predict(*model, [text(a, 999), text(b, 998), None, "12 !", ""])
    assert [g[0] for g in got] == ["en", "de", "und", "und", "und"] and all(0 <= g[1] <= 1 for g in got)


def test_langid_held_out(spark, monkeypatch):
    """No row that is held out trains; languages few rows have are learned; held-out accuracy on a real table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda rows: seen.append(rows) or ([], {}))
    marked = docs.select("doc_id", F.when(langid.held_out(), F.lit("held out " * 40)).otherwise(F.concat(F.lit("may train "), F.col("text"))).alias("text"), F.when(F.col("doc_id") == 1, "rare").otherwise(F.col("lang")).alias("lang"))
    langid.learn(marked)
    assert seen and not any("held out" in t for t, _ in seen[0]) and len(seen[0]) <= 5 * langid.SAMPLE_DOCS * langid.SAMPLE_WINDOWS
    assert "rare" in {n for _, n in seen[0]} or docs.where("doc_id = 1").where(~langid.held_out()).count() == 0
    monkeypatch.undo()
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.selectExpr("avg(cast(lang_pred = lang as int))").first()[0] > 0.97


def test_langid_windows():
    texts = [bytes(range(1, 1 + n % 200)) * (n // 100 + 1) for n in (1, 95, 96, 97, 250, 999)] + [b""]
    x, owner = langid.windows(texts)
    inside = x[langid.CONTEXT : langid.CONTEXT + langid.WINDOW]
    for k, t in enumerate(texts):
        assert inside[:, owner == k].T.tobytes().rstrip(b"\0") == t
    wide = x[:, owner == 5].T
    assert (wide[1, : langid.CONTEXT] == wide[0, langid.WINDOW : langid.WINDOW + langid.CONTEXT]).all()


def test_langid_gradient():
    w = {k: v.astype(np.float64) for k, v in langid.init(3).items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    use = np.ones((6, 4))
    loss, g = langid.gradients(w, x, y, use)
    for k in w:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        moved = {n: v.copy() for n, v in w.items()}
        moved[k][i] += 1e-2
        up = langid.gradients(moved, x, y, use)[0]
        moved[k][i] -= 2e-2
        down = langid.gradients(moved, x, y, use)[0]
        assert abs((up - down) / 2e-2 - g[k][i]) < 0.02 * abs(g[k][i]) + 1e-4


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
