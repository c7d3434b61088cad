"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

A window is ``WINDOW`` consecutive words of one document. Every word that lies
in a window whose word sequence also starts earlier (smaller doc_id, or same
document and earlier start) is removed; windows are judged on the input.

Words hash to 64 bits (XXH64); the hash of a window is a polynomial in them
modulo 2^64, built by doubling, beside 16 bits of a second one with another
base: 80 bits name a window. Each chunk of documents finds its own repeats and
sends its distinct windows as sorted lists; buckets of hashes answer which of
them an earlier chunk holds (see ``chunks``). Repeated windows merge into
maximal removal intervals.

Nulls and empty texts: no words, nothing removed. A null doc_id stands after
all others; rows with one doc_id are ordered by text, and each counts as a
document. Bytes need not be valid UTF-8. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import chunks as C
from .common import leanly, shuffle_partitions, small_batches

WINDOW = 20
BASES = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)
OUT = "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept binary"
SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def window_hashes(h: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial hash of every ``window`` consecutive values, by doubling."""
    mask = (1 << 64) - 1
    n = len(h) - window + 1
    out, size, part, width = None, 0, h, 1
    while True:
        if window & width:
            piece = part[size : size + n]
            out = piece.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + piece
            size += width
        if 2 * width > window:
            return out
        part = part[:-width] * np.uint64(pow(base, width, 1 << 64) & mask) + part[width:]
        width *= 2


def _windows(bodies: list[bytes], window: int):
    """(words by document, where each document begins among all words, starts of windows, their two hashes)."""
    docs = [b.split() for b in bodies]
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64)
    n = int(ends[-1]) if len(ends) else 0
    h = np.fromiter((x for d in docs for x in map(xxhash.xxh64_intdigest, d)), np.uint64, n)
    begins = np.concatenate([[0], ends]).astype(np.int64)
    if n < window:
        none = np.zeros(0, np.int64)
        return docs, begins, none, none.astype(np.uint64), none.astype(np.uint16)
    fits = np.ones(n - window + 1, bool)
    for e in ends[:-1]:
        fits[max(0, e - window + 1) : e] = False
    at = np.flatnonzero(fits)
    one = C.mix(window_hashes(h, window, BASES[0]))[at]
    two = (C.mix(window_hashes(h, window, BASES[1]))[at] >> np.uint64(48)).astype(np.uint16)
    return docs, begins, at, one, two


def _distinct(one: np.ndarray, two: np.ndarray):
    """(the first of each distinct window in hash order, the others)."""
    order, same = C.repeats((one, two))
    return order[~same], order[same]


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word intervals) and kept (the other words joined by a space)."""
    small_batches(docs.sparkSession)
    buckets = C.balanced_keys(docs.sparkSession, shuffle_partitions(docs.sparkSession))
    base = C.chunked(docs)

    def send(chunk: pa.Table) -> pa.Table:
        _, bodies = C.in_order(chunk)
        _, _, _, one, two = _windows(bodies, window)
        first, _ = _distinct(one, two)
        keys = one[first]
        return C.lists_table(chunk["g"][0].as_py(), buckets, C.spread(keys, len(buckets)), keys, two[first])

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, bodies = C.in_order(chunk)
        words, begins, at, one, two = _windows(bodies, window)
        first, again = _distinct(one, two)
        (held,) = C.read_bits(answers, buckets, C.spread(one[first], len(buckets)))
        n = int(begins[-1])
        gone = C.cover(at[np.concatenate([again, first[held]])], window, n)
        removed, spans, kept = [], [], []
        for i, w in enumerate(words):
            mask = gone[begins[i] : begins[i + 1]]
            k = int(mask.sum())
            removed.append(k)
            spans.append([{"begin": a, "end": b} for a, b in C.runs(mask).tolist()] if k else [])
            kept.append(b" ".join(compress(w, (~mask).tolist()) if k else w))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(begins), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})

    lists = base.groupBy("g").applyInArrow(leanly(send), C.LISTS)
    answers = C.earlier(lists, buckets, np.uint16)
    return base.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(leanly(finish), OUT)
