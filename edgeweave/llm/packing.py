"""Best-fit packing by minimum bin slack.

Documents become token ids with an end id; those longer than a sequence are cut
into full pieces, the first piece taking what is over. Then sequences are
filled: the longest piece left opens a sequence, a bitset subset-sum over the
lengths available finds the fullest feasible combination for the rest, and the
combination is removed; the same combination is used as often as the counts
allow.

A sequence holds at most ``capacity`` tokens, so there are at most ``capacity``
different lengths: the search runs on the histogram of lengths, whose size does
not grow with the corpus, and packs all documents together. Its answer is a
list of slots: ranges of ranks within a length, each with its first sequence
and offset. Pieces get their rank within their length from blocks (a hash of the
piece) that are counted first, so a length that a third of all pieces has is
not one task.

Nulls and empty texts are the end id alone. A null doc_id is a document like any
other. Repeated rows are packed each on their own; alike pieces may swap places
between runs, which changes no row of the result. An empty table packs nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, materialise, shuffle_partitions
from .tokens import default_path, encoder

CAPACITY = 2048
END = np.array([0], "<u4").tobytes()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``ids`` (binary, little-endian unsigned 32-bit) if asked for."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for doc, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), strict=True):
                ids = enc.encode(body or "") + END
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * x : 4 * y]
                    rows.append((doc, k, x, y - x, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            out = {"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()), **{c: pa.array(v, pa.int64()) for c, v in zip(("start", "length", "ids_crc32"), cols[2:5], strict=True)}}
            yield pa.record_batch(out | ({"ids": pa.array(cols[5], pa.binary())} if with_ids else {}))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("body"))
    return mapped(slim, run, PIECES + (", ids binary" if with_ids else ""))


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """The (length, times) whose sum is the largest up to ``room``. ``lengths``: those available, longest first."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for x in lengths:
        if x > room:
            continue
        left, take = min(counts[x], room // x), 1
        while left > 0:
            k = min(take, left)
            steps.append((x, k, reach))
            reach |= (reach << x * k) & mask
            left, take = left - k, 2 * take
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            out[x] = out.get(x, 0) + k
            at -= x * k
    return list(out.items())


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences as (how many alike, [(length, times)]), for ``histogram`` (length: number of pieces)."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        used = {top: 1}
        for x, k in fullest(capacity - top, counts, lengths) if capacity > top else []:
            used[x] = used.get(x, 0) + k
        counts[top] += 1
        alike = min(counts[x] // k for x, k in used.items())
        out.append((alike, sorted(used.items(), reverse=True)))
        for x, k in used.items():
            counts[x] -= alike * k
        if any(not counts[x] for x in used):
            lengths = [x for x in lengths if counts[x]]
    return out


def slots(sequences: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: (first ranks ascending, first sequence, offset) of its slots."""
    got: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for alike, used in sequences:
        offset = 0
        for x, k in used:
            for _ in range(k):
                got.setdefault(x, []).append((rank.get(x, 0), sequence, offset))
                rank[x] = rank.get(x, 0) + alike
                offset += x
        sequence += alike
    return {x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in got.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset."""
    blocks = max(16, 2 * shuffle_partitions(pieces.sparkSession))
    keys = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in pieces.columns]
    dealt = pieces.withColumn("__block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    counts = materialise(dealt.groupBy("length", "__block").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    place = slots(minimum_slack(histogram, capacity))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("__length"), F.col("__block").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("length", "__block").orderBy(*keys)
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(materialise(starts, "starts"), (F.col("length") == F.col("__length")) & (F.col("__block") == F.col("__b")))
    ranked = ranked.select(*pieces.columns, (F.col("__rank") + F.col("__first")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, seq, off = place[x]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            out = {c: b.column(c) for c in b.schema.names if c != "rank"}
            yield pa.record_batch(out | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return mapped(ranked, run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset of all documents."""
    return pack(materialise(cut_pieces(docs, capacity, path, text, with_ids), "pieces"), capacity)
