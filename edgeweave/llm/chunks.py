"""Chunks of documents in doc_id order, and exchange of key lists between them.

Operators that look for earlier occurrences of a window share this frame:

* ``chunked`` cuts the documents at doc_id quantiles into a few chunks per
  shuffle partition. Chunk numbers rise with doc_id, so "starts earlier" across
  chunks is "has the smaller chunk number" and no position travels with a key.
* Each chunk sends, per bucket of keys, the sorted list of its distinct keys
  (``pack``). A key that a chunk holds a thousand times is sent once, which
  keeps a passage that a third of all documents share from being hot.
* ``earlier`` answers with one bit a key: does a chunk before this one hold it?

The text is dealt out once; the plan reuses that exchange wherever it is read
again. Key lists and bits are recomputed from it if an executor is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, leanly, shuffle_partitions

CHUNKS_PER_PARTITION = 2
LISTS = "b int, g int, data binary"


def chunked(docs: DataFrame, text: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """``docs`` as doc_id, id (never null), body (binary) and chunk number g (and a struct of ``carry``), dealt out by g.

    Rows of one doc_id share a chunk.
    """
    n = shuffle_partitions(docs.sparkSession)
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    chunks = CHUNKS_PER_PARTITION * n
    cuts = docs.select(ident.alias("i")).agg(F.percentile_approx("i", [k / chunks for k in range(1, chunks)], 10 * chunks).alias("q")).first()["q"]
    slim = docs.select("doc_id", ident.alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), *([F.struct(*carry).alias("carry")] if carry else []))
    return slim.withColumn("g", _below(F.col("id"), sorted(set(cuts or [])))).repartition(n, "g")


def _below(value: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` are below ``value``, by bisection."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded to a constant
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when(F.get(table, at + s - 1) < value, s).otherwise(F.lit(0)))


def balanced_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that ``repartition(n, "b")`` deals to a partition each; at most ``n`` rows are collected."""
    key = F.col("id").cast("int")
    found = spark.range(0, 64 * n + 64).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("p")).agg(F.min(key).alias("b")).collect()
    spare = iter(range(64 * n + 64, 65 * n + 64))  # for a partition that none was found for: any other number is right too
    keys = [r["b"] for r in found]
    return keys + [next(spare) for _ in range(n - len(keys))]


def by_bucket(lists: DataFrame, keys: list[int]):
    """``lists`` grouped by b, each bucket its own task: lists of many chunks must not meet in a few."""
    return lists.repartition(len(keys), "b").groupBy("b")


def _order(chunk: pa.Table) -> list[int]:
    ids, bodies = chunk["id"].to_pylist(), chunk["body"].to_pylist()
    return sorted(range(len(bodies)), key=lambda i: (ids[i], bodies[i]))


def carried(chunk: pa.Table) -> pa.ChunkedArray:
    """The carried columns in the order of ``in_order``."""
    return chunk["carry"].take(pa.array(_order(chunk), pa.int64()))


def in_order(chunk: pa.Table) -> tuple[list, list[bytes]]:
    """The chunk's doc_ids and texts by id; repeated ids by text."""
    bodies, doc_ids, order = chunk["body"].to_pylist(), chunk["doc_id"].to_pylist(), _order(chunk)
    return [doc_ids[i] for i in order], [bodies[i] for i in order]


def pack(first: np.ndarray, *more: np.ndarray) -> bytes:
    """A list of keys: ``first`` (uint64, ascending) as byte planes of its differences, ``more`` as they are."""
    delta = np.diff(first, prepend=np.uint64(0))
    planes = delta.view(np.uint8).reshape(-1, 8).T.tobytes()
    head = np.uint32(len(first)).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + planes + b"".join(x.tobytes() for x in more))


def unpack(data: bytes, *kinds) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    delta = np.frombuffer(raw, np.uint8, 8 * n, 4).reshape(8, n).T.copy().view(np.uint64).reshape(n)
    out, at = [np.cumsum(delta, dtype=np.uint64)], 4 + 8 * n
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return tuple(out)


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin and end in ``keys`` (uint64, ascending, evenly spread)."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


def lists_table(g: int, buckets: list[int], edges: np.ndarray, first: np.ndarray, *more: np.ndarray) -> pa.Table:
    """A row a bucket that isn't empty; edges[i] to edges[i + 1] is bucket buckets[i]."""
    full = [i for i in range(len(edges) - 1) if edges[i + 1] > edges[i]]
    data = [pack(first[(s := slice(edges[i], edges[i + 1]))], *[x[s] for x in more]) for i in full]
    return pa.table({"b": pa.array([buckets[i] for i in full], pa.int32()), "g": pa.array([g] * len(full), pa.int32()), "data": pa.array(data, pa.binary())})


def joined_lists(bucket: pa.Table, *kinds) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(chunk numbers ascending, where each one's keys begin, the keys one after another)."""
    rows = sorted(zip(bucket["g"].to_pylist(), bucket["data"].to_pylist(), strict=True))
    parts = [unpack(d, *kinds) for _, d in rows]
    starts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64)
    return np.array([g for g, _ in rows], np.int32), starts, tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def repeats(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(an order that brings equal keys together and keeps their order, whether each key there equals the one before)."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    same = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    same[:1] = False
    return order, same


def bits_table(b: int, chunks: np.ndarray, starts: np.ndarray, *flags: np.ndarray) -> pa.Table:
    """The answers of a bucket: a row a chunk with one packed bit a key for each of ``flags``."""
    data = [b"".join(np.packbits(f[starts[i] : starts[i + 1]]).tobytes() for f in flags) for i in range(len(chunks))]
    return pa.table({"b": pa.array([b] * len(chunks), pa.int32()), "g": pa.array(chunks, pa.int32()), "data": pa.array(data, pa.binary())})


def read_bits(answers: pa.Table, buckets: list[int], edges: np.ndarray, count: int = 1) -> list[np.ndarray]:
    """The ``count`` flags of a chunk's keys, from its rows of ``bits_table``."""
    n, place = int(edges[-1]), {b: i for i, b in enumerate(buckets)}
    out = [np.zeros(n, bool) for _ in range(count)]
    for b, data in zip(answers["b"].to_pylist(), answers["data"].to_pylist(), strict=True):
        i = place[b]
        size = int(edges[i + 1] - edges[i])
        raw, step = np.frombuffer(data, np.uint8), (size + 7) // 8
        for k in range(count):
            out[k][edges[i] : edges[i + 1]] = np.unpackbits(raw[k * step : (k + 1) * step], count=size).astype(bool)
    return out


def earlier(lists: DataFrame, buckets: list[int], *kinds) -> DataFrame:
    """Per chunk and bucket, one bit a key: whether a chunk before holds it too."""

    def answer(bucket: pa.Table) -> pa.Table:
        chunks, starts, keys = joined_lists(bucket, *kinds)
        order, same = repeats(keys)
        flags = np.zeros(len(order), bool)
        flags[order] = same
        return bits_table(bucket["b"][0].as_py(), chunks, starts, flags)

    return by_bucket(lists, buckets).applyInArrow(leanly(answer), LISTS)


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values in place (a bijection)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in windows of ``length`` at the distinct ``starts``."""
    change = np.zeros(n + 1, np.int32)
    change[starts] += 1
    change[starts + length] -= 1
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """The maximal runs of True as rows (begin, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)
