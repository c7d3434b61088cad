"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into lower-case words. The hashes of their ``GRAM``-word grams
are winnowed (the smallest in every ``WINNOW`` consecutive ones), and the grams
kept form an inverted index: gram -> (template, place). Every gram of a document
is looked up; a hit names a template and a diagonal. Hits of one template on
diagonals within ``BAND`` are one candidate, which is aligned with the template
inside that band (longest common subsequence of words). Where the share of the
template's words that align reaches ``COVERAGE``, the match is reported with
its coverage and its character span.

Any copy that keeps a run of ``GRAM + WINNOW - 1`` words of the template is
found. The index has the size of the templates and travels with the tasks.

Nulls and empty texts match nothing. Repeated rows are scanned each on their
own; overlapping matches of one template leave the one with the best coverage,
then the first. Whole texts are scanned whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
GRAM = 3
WINNOW = 3
BAND = 6
COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

#: Public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def winnowed(grams: list[tuple[str, ...]], window: int = WINNOW) -> set[int]:
    """Places of the grams kept: the smallest hash of every ``window`` consecutive ones, the last among equals."""
    h = [(xxhash.xxh64_intdigest(" ".join(g)), -i) for i, g in enumerate(grams)]
    return {-min(h[i : i + window])[1] for i in range(max(1, len(h) - window + 1)) if h}


class Index:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: words(t) for name, t in templates.items()}
        self.grams: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, w in self.words.items():
            grams = [tuple(w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
            for i in sorted(winnowed(grams)):
                self.grams.setdefault(grams[i], []).append((name, i))
        self.first = {g[0] for g in self.grams}

    def candidates(self, doc: list[str]) -> list[tuple[str, int]]:
        """(template, diagonal): hits on near diagonals count once, at their middle."""
        hits: dict[str, list[int]] = {}
        for i in [i for i, w in enumerate(doc) if w in self.first]:
            for name, j in self.grams.get(tuple(doc[i : i + GRAM]), ()):
                hits.setdefault(name, []).append(i - j)
        out = []
        for name, diagonals in hits.items():
            diagonals.sort()
            begin = last = diagonals[0]
            for d in diagonals[1:] + [None]:
                if d is None or d - begin > BAND:
                    out.append((name, (begin + last) // 2))
                    begin = d
                last = d
        return out


def align(template: list[str], doc: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(words aligned, first and last aligned word of ``doc``): longest common subsequence within the band."""
    width = 2 * band + 1
    none = (0, -1, -1)
    # cell k of row i: template words up to i against document words up to i + diagonal + k - band
    row = [none] * width
    for i, t in enumerate(template):
        new = [none] * width
        for k in range(width):
            j = i + diagonal + k - band
            best = row[k + 1] if k + 1 < width else none
            if k and new[k - 1][0] > best[0]:
                best = new[k - 1]
            if 0 <= j < len(doc) and doc[j] == t and row[k][0] >= best[0]:
                n, a, _ = row[k]
                best = (n + 1, j if n == 0 else a, j)
            new[k] = best
        row = new
    return max(row, key=lambda x: x[0])


def scan(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, words aligned, begin, end) of the matches in ``text``, by place."""
    doc = words(text)
    found: dict[str, list[tuple[float, int, int, int]]] = {}
    for name, diagonal in index.candidates(doc):
        t = index.words[name]
        n, a, b = align(t, doc, diagonal)
        if n and n / len(t) >= coverage:
            found.setdefault(name, []).append((n / len(t), n, a, b))
    if not found:
        return []
    at = [m.span() for m in _WORD.finditer(text.lower())] if len(text.lower()) == len(text) else _spans(text)
    out = []
    for name, matches in found.items():
        taken: list[tuple[int, int]] = []
        for c, n, a, b in sorted(matches, key=lambda x: (-x[0], x[2], x[3])):
            if all(b < x or a > y for x, y in taken):
                taken.append((a, b))
                out.append((name, c, n, at[a][0], at[b][1]))
    return sorted(out, key=lambda x: (x[3], x[4], x[0]))


def _spans(text: str) -> list[tuple[int, int]]:
    """Word spans in ``text`` where lower-casing changes its length: characters are followed one by one."""
    place = [i for i, ch in enumerate(text) for _ in ch.lower()]
    return [(place[m.start()], place[m.end() - 1] + 1) for m in _WORD.finditer("".join(ch.lower() for ch in text))]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """doc_id, license, coverage, n_matched, span_begin, span_end: a row a match."""
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for b in batches:
            rows = [(d, *m) for d, x in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), strict=True) if x for m in scan(x, index, coverage)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            names = ("doc_id", "license", "coverage", "n_matched", "span_begin", "span_end")
            yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("body"))
    return mapped(slim, run, "doc_id long, license string, coverage double, n_matched int, span_begin int, span_end int")
