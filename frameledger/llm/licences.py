"""Licence scans with a positional index of licence words.

A first pass over the texts stores, per document, the postings (place, word) of the words that occur
in a licence template, and nothing later reads a text again. Document frequencies over all
documents give the words' IDF. A document's licence words are then looked up in the templates' postings (word to template and
place), those of the highest IDF first and for each template until what is left of it couldn't make up a copy. The difference of the
two places is where the template would begin; these beginnings are intersected with the lists of the template's other words, dropping those that
miss too much, and for the rest the coverage is measured, words in order, and the mandatory phrases are verified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, store, table
from .shingles import batches, word_hashes

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: The phrases whose places are counted, and their labels (fixed values).
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that must stand at their places in the text.
    mandatory: tuple[str, ...]


#: Characteristic passages and whole texts of public licences (fixed values).
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("www apache org licenses license 2 0",)),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "either version 3 of the license")),
    Template("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "either version 2 of the license")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("mit", "Released under the MIT License", ("under the mit license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
        ("permission is hereby granted free of charge", "the software is provided as is"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
        ("with or without fee is hereby granted", "the author disclaims all warranties"),
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution",
        ("must not be misrepresented", "this notice may not be removed or altered"),
    ),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
)
LEAST_COVERAGE = 0.8
#: Words by which parts of a copy may be shifted, as by words put in or left out.
TOLERANCE = 4


def words_of(text: str) -> list[str]:
    lower = text.translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


class _Vocabulary:
    """The templates' and base phrases' words, numbered; their number doesn't depend on the corpus."""

    def __init__(self, templates: tuple[Template, ...], base: dict[str, str]):
        texts = [*base.values(), *[t.text for t in templates], *[p for t in templates for p in t.mandatory]]
        self.words = sorted({w for t in texts for w in words_of(t)})
        self.number = {w: i for i, w in enumerate(self.words)}
        hashes = np.concatenate([word_hashes(w.encode(), _BETWEEN)[0] for w in self.words]) if self.words else np.empty(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def numbers(self, text: str) -> list[int]:
        return [self.number[w] for w in words_of(text)]


def index_documents(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, places, words): the postings of licence words, as packed 32-bit integers in order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(templates, base)
        for batch in rows:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts: list[int] = []
            places: list[bytes] = []
            words: list[bytes] = []
            for _, buffer, firsts in batches(texts):
                hashes, starts = word_hashes(buffer, _BETWEEN)
                found = vocabulary.find(hashes)
                hits = np.flatnonzero(found >= 0)
                cuts = np.searchsorted(starts, np.append(firsts, len(buffer) + 1))
                marks = np.searchsorted(hits, cuts)
                for k in range(len(cuts) - 1):
                    own = hits[marks[k] : marks[k + 1]]
                    counts.append(int(cuts[k + 1] - cuts[k]))
                    places.append((own - cuts[k]).astype("<i4").tobytes())
                    words.append(found[own].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.binary()), pa.array(words, pa.binary())], names=["id", "n_words", "places", "words"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, places binary, words binary")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(word, n_docs) over the whole index; a partition gives one row a word at most."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in rows:
            for packed in batch.column(0).to_pylist():
                seen.update(np.unique(np.frombuffer(packed, dtype="<i4")).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return index.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))


def _runs(places: np.ndarray, words: np.ndarray, phrase: list[int]) -> np.ndarray:
    """The places at which the phrase's words stand one after another."""
    n = len(words) - len(phrase) + 1
    if n <= 0 or not phrase:
        return places[:0]
    hit = words[:n] == phrase[0]
    for k in range(1, len(phrase)):
        hit &= words[k : k + n] == phrase[k]
    spots = np.flatnonzero(hit)
    return places[spots[places[spots + len(phrase) - 1] - places[spots] == len(phrase) - 1]]


class _Matcher:
    """Templates by their words: ``postings`` says of a word in which templates it stands, and with which share of their weight."""

    def __init__(self, templates: tuple[Template, ...], base: dict[str, str], idf: np.ndarray, vocabulary: _Vocabulary, least: float, tolerance: int):
        self.least, self.tolerance, self.idf = least, tolerance, idf
        self.base = [(label, vocabulary.numbers(p)) for label, p in base.items()]
        self.templates = []
        self.postings: dict[int, list[tuple[int, float]]] = {}
        for i, t in enumerate(templates):
            own = np.array(vocabulary.numbers(t.text))
            weights = idf[own]
            phrases = []
            for p in map(vocabulary.numbers, t.mandatory):
                at = next((i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)].tolist() == p), None)
                if at is None:
                    raise ValueError(f"a mandatory phrase isn't in its template: {t.label}")
                phrases.append((at, np.array(p)))
            weights = weights / weights.sum()
            self.templates.append((t.label, own, weights, phrases, np.argsort(-weights, kind="stable")))
            for w in sorted(set(own.tolist())):
                self.postings.setdefault(w, []).append((i, float(weights[own == w].sum())))

    def _looked_up(self, words: np.ndarray) -> dict[int, list[int]]:
        """Template to the document's words that it was found by, in the order of their IDF.

        A word is looked up for a template as long as its words not yet looked up could reach the least coverage, so a copy has one of these in its place.
        """
        present = np.unique(words)
        left: dict[int, float] = {}
        for w in present.tolist():
            for i, share in self.postings.get(w, ()):
                left[i] = left.get(i, 0.0) + share
        found: dict[int, list[int]] = {}
        for w in present[np.lexsort((present, -self.idf[present]))].tolist():
            for i, share in self.postings.get(w, ()):
                if left[i] >= self.least - 1e-9:
                    found.setdefault(i, []).append(w)
                left[i] -= share
        return found

    def _begins(self, looked_up: list[int], places: np.ndarray, words: np.ndarray, own: np.ndarray, weights: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Where a template may begin: the relative places of the looked-up words, intersected with the lists of all its words.

        A word may stand ``tolerance`` off its place. Beginnings that miss more than a copy may are dropped on the way, the
        rarest words coming first.
        """
        spots = {w: places[words == w].astype(np.int64) for w in set(own.tolist())}
        offsets = [(spots[w][:, None] - np.flatnonzero(own == w)[None, :]).ravel() for w in looked_up]
        shifts = np.arange(-self.tolerance, self.tolerance + 1)
        begins = np.unique((np.unique(np.concatenate(offsets))[:, None] + shifts[None, :]).ravel())
        missed = np.zeros(len(begins))
        for k in order.tolist():
            at = spots[own[k]]
            reach = np.searchsorted(at, begins + k + self.tolerance, "right") > np.searchsorted(at, begins + k - self.tolerance)
            missed += np.where(reach, 0.0, weights[k])
            stay = missed <= 1 - self.least + 1e-9
            begins, missed = begins[stay], missed[stay]
            if not len(begins):
                break
        return begins

    def _coverage(self, begin: int, places: np.ndarray, words: np.ndarray, own: np.ndarray, weights: np.ndarray) -> float:
        """The largest weight of template words that stand in order, none shifted by more than the tolerance."""
        ends: list[tuple[int, float]] = []  # place of the last word taken, weight so far
        lo = np.searchsorted(places, begin - self.tolerance)
        hi = np.searchsorted(places, begin + len(own) + self.tolerance)
        here = list(zip(places[lo:hi].tolist(), words[lo:hi].tolist(), strict=True))
        for k, (word, weight) in enumerate(zip(own.tolist(), weights.tolist(), strict=True)):
            ends += [(p, weight + max((v for q, v in ends if q < p), default=0.0)) for p, w in here if w == word and abs(p - begin - k) <= self.tolerance]
        return max((v for _, v in ends), default=0.0)

    def __call__(self, places: np.ndarray, words: np.ndarray) -> tuple[int, int | None, int | None, list[str], list[str], float]:
        n_base, first, last, labels = 0, None, None, set()
        for label, phrase in self.base:
            spots = _runs(places, words, phrase)
            if len(spots):
                n_base += len(spots)
                first = int(spots[0]) if first is None else min(first, int(spots[0]))
                last = int(spots[-1]) if last is None else max(last, int(spots[-1]))
                labels.add(label)
        found, score = set(labels), 1.0 if labels else 0.0
        for i, looked_up in sorted(self._looked_up(words).items()):
            label, own, weights, phrases, order = self.templates[i]
            stand = [(k, _runs(places, words, p.tolist())) for k, p in phrases]
            if not all(len(spots) for _, spots in stand):
                continue
            for begin in self._begins(looked_up, places, words, own, weights, order).tolist():
                if not all(np.searchsorted(spots, begin + k + self.tolerance, "right") > np.searchsorted(spots, begin + k - self.tolerance) for k, spots in stand):
                    continue
                coverage = self._coverage(begin, places, words, own, weights)
                if coverage >= self.least:
                    found.add(label)
                    score = max(score, min(1.0, round(coverage, 9)))
        return n_base, first, last, sorted(labels), sorted(found), score


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COVERAGE, tolerance: int = TOLERANCE) -> DataFrame:
    """Per document (``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``score`` is 1 where a base phrase stands, else the best coverage of a template found, by IDF weight,
    else 0. Null and empty texts have no words and no labels. Rows are judged one by one, so repeated
    rows and null ids are kept; further columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    index = store(index_documents(docs, templates, base, id_col, text_col), fresh_path(spark, "licences"))
    vocabulary = _Vocabulary(templates, base)
    total = index.count()
    idf = np.full(len(vocabulary.words), np.log(1.0 + total))
    for row in document_frequencies(index).collect():  # a row a vocabulary word
        idf[row["word"]] = np.log((1.0 + total) / (1.0 + row["n_docs"]))
    idf += 1e-6  # a word that every document has still counts for something

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(templates, base, idf, _Vocabulary(templates, base), least, tolerance)
        for batch in rows:
            out = [match(np.frombuffer(p, dtype="<i4"), np.frombuffer(w, dtype="<i4")) for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array([",".join(x) for x in c], pa.string()) for c in cols[3:5]], pa.array(cols[5], pa.float64())],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return index.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


#: The base columns, which tests compare; the method's own labels can't be put as SQL.
BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, i - 1 AS i, w[i:i+3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
), b AS (
  SELECT doc_id, i, CASE WHEN g = ['under', 'the', 'mit', 'license'] THEN 'mit' WHEN g = ['apache', 'license', 'version', '2'] THEN 'apache-2' WHEN g[1:3] = ['cc', 'by', 'nc'] THEN 'cc-by-nc' END AS label FROM p
), s AS (
  SELECT doc_id, count(*)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b WHERE label IS NOT NULL GROUP BY doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN s USING (doc_id)
"""
