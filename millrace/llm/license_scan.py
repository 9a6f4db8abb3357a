"""License scans by a positional index of rare template words.

Each template is a text that a licence or its notice holds. Of a file's licence words, those of the highest inverse
document frequency over the whole corpus look up the templates: for each template its rarest words, just so many that
what is left out can't reach the needed weight alone. Every posting (template, place in template) at a word's place
votes for the offset place - template place. Postings are intersected by relative position: the votes of offsets that
lie within GAP of each other have to reach the needed weight with all that is left out. Then the words of the template
that stand there in order are weighed, up to GAP other words among them on either side of a looked-up one, and a label needs the template's mandatory
phrases there too, word by word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import spread

#: A-Z to lower case, other ASCII that isn't a digit or letter to a blank; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Words that may stand among those of a template on either side of a looked-up word, and the share of its weight that has to be there.
GAP, LEAST = 8, 0.8

#: Phrases that give a label by themselves.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


#: Sentences of public licence texts and notices, folded; each with the phrases that it can't lack.
TEMPLATES = (
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice shall be included",)),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("the software is provided as is", "authors or copyright holders")),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("provided by the copyright holders and contributors",)),
    Template("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("the author disclaims all warranties",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    Template("apache-2", "released under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("unless required by applicable law", "as is basis")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("commons attribution 4 0",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("gpl-2", "this program is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source", "following conditions are met")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose", "with or without fee")),
    Template("all-rights-reserved", "copyright all rights reserved", ("all rights reserved",)),
    Template("proprietary", "this document is proprietary and confidential", ("proprietary and confidential",)),
    Template("public-domain", "this work is dedicated to the public domain", ("public domain",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Index:
    """Postings of the templates' words, and their weight by the corpus's document frequencies."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST) -> None:
        self.templates = [(t.label, t.text.encode().split(), [b" " + m.encode() + b" " for m in t.mandatory]) for t in templates]
        self.least = least
        self.base = [(tuple(p.encode().split()), label) for p, label in BASE.items()]
        self.words = frozenset(w for _, words, _ in self.templates for w in words)
        self.vocabulary = self.words | {w for phrase, _ in self.base for w in phrase}

    def weigh(self, documents: int, frequency: dict[bytes, int]) -> Index:
        """Idf per word, the sum over each template, and the postings of each template's rarest words."""
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1e-9 for w in self.words}
        self.whole = [sum(self.idf[w] for w in template) for _, template, _ in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.left_out = []
        for k, (_, template, _) in enumerate(self.templates):
            rest = self.whole[k]
            for w in sorted(set(template), key=lambda w: (-self.idf[w], w)):
                if rest < self.needed(k):
                    break
                places = [at for at, x in enumerate(template) if x == w]
                self.postings[w] += [(k, at) for at in places]
                rest -= self.idf[w] * len(places)
            self.left_out.append(max(0.0, rest))
        return self

    def needed(self, k: int) -> float:
        return self.least * (1 - 1e-9) * self.whole[k]

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        hits: dict[bytes, list[int]] = {}
        for at in [i for i, w in enumerate(words) if w in self.vocabulary]:
            hits.setdefault(words[at], []).append(at)
        starts, base = [], set()
        for phrase, label in self.base:
            n = len(phrase)
            found = [at for at in hits.get(phrase[0], ()) if tuple(words[at : at + n]) == phrase] if all(w in hits for w in phrase) else []
            if found:
                starts += found
                base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        votes: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for w in hits:
            for k, place in self.postings.get(w, ()):
                votes[k] += [(at - place, self.idf[w]) for at in hits[w]]
        for k, cast in votes.items():
            part = self.best(k, sorted(cast), words)
            if part:
                labels.add(self.templates[k][0])
                score = max(score, min(1.0, part))
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score

    def best(self, k: int, cast: list[tuple[int, float]], words: list[bytes]) -> float:
        """The largest share of template k that stands in order at an offset with its phrases there; 0 for too little."""
        _, template, mandatory = self.templates[k]
        best, begin, reached, seen = 0.0, 0, 0.0, None
        for end, (offset, weight) in enumerate(cast):
            reached += weight
            while cast[begin][0] < offset - GAP:
                reached -= cast[begin][1]
                begin += 1
            low = cast[begin][0]
            if low == seen or reached + self.left_out[k] < self.needed(k) or best >= 1:
                continue
            if end + 1 < len(cast) and cast[end + 1][0] <= low + GAP:
                continue  # the cluster goes on
            seen = low
            region = words[max(0, low - GAP) : max(0, low + len(template) + 2 * GAP)]
            if all(m in b" " + b" ".join(region) + b" " for m in mandatory):
                part = self.in_order(template, region) / self.whole[k]
                best = max(best, part) if part >= self.least else best
        return best

    def in_order(self, template: list[bytes], region: list[bytes]) -> float:
        """Weight of the heaviest common subsequence of words."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, w in enumerate(template):
            places[w].append(at)
        held = [0.0] * (len(template) + 1)  # held[i]: the heaviest that ends before place i
        for w in region:
            for at in reversed(places.get(w, ())):
                reached = held[at] + self.idf[w]
                for i in range(at + 1, len(held)):
                    if held[i] >= reached:
                        break
                    held[i] = reached
        return held[-1]


def document_frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each template word: over all documents, in one pass."""
    vocabulary = index.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                seen.update(vocabulary.intersection(words_of(text.as_py())))
        words = [*seen, b""]
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words]), pa.array([*seen.values(), n], pa.int64())], ["word", "n"])

    rows = spread(docs.select(text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}  # one row per template word
    return found.pop(b"", 0), found


def scan_licenses(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: what Index.scan finds in the whole text.

    Null and empty texts have no words and no labels; repeated rows are rows of their own; null ids stay null;
    other columns are ignored; no rows give no rows.
    """
    index = index or Index()
    index.weigh(*document_frequencies(docs, index, text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [index.scan(text.as_py()) for text in batch.column(1)]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", *names])

    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
