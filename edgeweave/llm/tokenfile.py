"""Token ids in Simple-8b files.

A 64-bit word holds a 4-bit selector and 60 bits of payload: as many values of
the selector's width as fit, from sixty of 1 bit to one of 60 bits, or a run of
240 zeros. Values of more than 60 bits are escapes: the word holds the place of
the value in a list of full words at the end of the file.

A file holds documents in order: a table of their ids and lengths, a codebook
(ids of the file by falling frequency; what is packed is the rank, so that
frequent ids take few bits), blocks of ``BLOCK`` ranks that each begin a new
word, the word offset of each block, the words, the escapes. With the offsets
all blocks are decoded at once, by numpy.

``write_token_files`` range-partitions the documents by doc_id, and every task
writes its files in order, each of at most about ``FILE_IDS`` ids. A file is a
row of a Parquet table (part, seq, n_ids, n_docs, file): Spark's writer commits
them, so a lost executor leaves no half-written file, and any store that Spark
reaches will do.

Nulls and empty texts are the end id alone. A null doc_id stands after all
others and comes back as null; rows with one doc_id are ordered by text. An
empty table gives no file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID, mapped, materialise, shuffle_partitions
from .tokens import default_path, encoder

#: Selector: (values a word, bits a value). 15 is the escape.
SELECTORS = ((240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 1024
FILE_IDS = 800_000
#: Values in memory stand in rows of a block and of what a word may hold beyond it.
ROW = BLOCK + 240
MAGIC = b"S8B1"
_COUNTS = np.array([n for n, _ in SELECTORS] + [1], np.int64)


def pack_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and the end, escapes) of unsigned 64-bit ``values``."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    v = np.zeros((blocks, ROW), np.uint32 if int(values.max()) >> 32 == 0 else np.uint64)
    full = n // BLOCK
    v[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    v[full:, : n - full * BLOCK] = values[full * BLOCK :]
    choice = _choices(_bit_length(v))
    begin = np.zeros(blocks * ROW, bool)
    pos, live = np.zeros(blocks, np.int64), np.arange(blocks)
    while len(live):
        at = live * ROW + pos[live]
        begin[at] = True
        pos[live] += _COUNTS[choice[at]]
        live = live[pos[live] < BLOCK]
    begin.reshape(blocks, ROW)[-1, n - (blocks - 1) * BLOCK :] = False  # beyond the last value there is nothing to write
    at = np.flatnonzero(begin)
    s, flat = choice[at], v.reshape(-1)
    words = s.astype(np.uint64) << np.uint64(60)
    for sel, (k, width) in enumerate(SELECTORS):
        if width and len(w := np.flatnonzero(s == sel)):
            first = at[w]
            word = words[w]
            for j in range(k):
                word |= flat[first + j].astype(np.uint64) << np.uint64(j * width)
            words[w] = word
    w = np.flatnonzero(s == ESCAPE)
    words[w] |= np.arange(len(w), dtype=np.uint64)
    offsets = np.searchsorted(at, np.arange(blocks + 1) * ROW).astype(np.uint32)
    return words, offsets, flat[at[w]].astype(np.uint64)


def _choices(bits: np.ndarray) -> np.ndarray:
    """For each place the selector of the longest run that fits, from the widths ``bits`` of the values."""
    choice, wide, size = np.full(bits.shape, ESCAPE, np.uint8), bits, 1
    for s in range(len(SELECTORS) - 1, -1, -1):
        k, width = SELECTORS[s]
        while 2 * size <= k:  # wide: the widest of ``size`` values from each place on
            wide = np.maximum(wide[:, :-size], wide[:, size:])
            size *= 2
        most = np.maximum(wide[:, :BLOCK], wide[:, k - size : k - size + BLOCK])
        choice[:, :BLOCK][most <= width] = s
    return choice.reshape(-1)


def _bit_length(v: np.ndarray) -> np.ndarray:
    if v.size and (most := int(v.max())) < 1 << 20:  # by table, as for ranks
        table = np.zeros(most + 1, np.uint8)
        for k in range(most.bit_length()):
            table[1 << k :] = k + 1
        return table[v]
    out = np.zeros(v.shape, np.uint8)
    x = v.copy()
    for k in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1) << np.uint64(k)
        out[big] += k
        x[big] >>= np.uint64(k)
    return out + (x > 0)


def unpack_words(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    s = (words >> np.uint64(60)).astype(np.uint8)
    body = words & np.uint64((1 << 60) - 1)
    counts = _COUNTS[s]
    begins = np.cumsum(counts) - counts
    first = offsets[:-1].astype(np.int64)
    # in rows with room for what the last word of a block holds beyond it
    blocks = len(first)
    at = begins + np.repeat(np.arange(blocks) * ROW - begins[first], np.diff(offsets.astype(np.int64))) if len(words) else begins
    small = max([SELECTORS[x][1] for x in np.unique(s[s != ESCAPE]).tolist()], default=0) <= 32 and not len(escapes)
    out = np.zeros(blocks * ROW, np.uint32 if small else np.uint64)
    for sel, (k, width) in enumerate(SELECTORS):
        if width and len(w := np.flatnonzero(s == sel)):
            to, word, mask = at[w], body[w], np.uint64((1 << width) - 1)
            for j in range(k):
                out[to + j] = word >> np.uint64(j * width) & mask
    w = np.flatnonzero(s == ESCAPE)
    out[at[w]] = escapes[body[w].astype(np.int64)]
    return out.reshape(blocks, ROW)[:, :BLOCK].reshape(-1)[:n]


def write_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one file: documents with ``lengths`` ids each, one after another in ``ids`` (below 2^32)."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        found = np.flatnonzero(counts)
        times, place = counts[found], ids
    else:
        found, place, times = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.zeros(int(found.max()) + 1 if place is ids and len(ids) else len(found), np.uint32)
    rank[found[order] if place is ids and len(ids) else order] = np.arange(len(order), dtype=np.uint32)
    words, offsets, escapes = pack_words(rank[place])
    head = np.array([len(doc_ids), len(ids), len(found), len(words), len(offsets), len(escapes)], "<u8")
    parts = (head, np.array(doc_ids, "<i8"), np.array(lengths, "<u8"), found[order].astype("<u4"), offsets.astype("<u4"), words.astype("<u8"), escapes.astype("<u8"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids as unsigned 32-bit)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n, book, words, offsets, escapes = np.frombuffer(data, "<u8", 6, 4).tolist()
    at, out = 52, []
    for count, kind in ((docs, "<i8"), (docs, "<u8"), (book, "<u4"), (offsets, "<u4"), (words, "<u8"), (escapes, "<u8")):
        out.append(np.frombuffer(data, kind, count, at))
        at += count * np.dtype(kind).itemsize
    ranks = unpack_words(out[4], out[3], out[5], n)
    return out[0], out[1], out[2][ranks.astype(np.int64)] if n else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end: int = 0, text: str = "text", file_ids: int = FILE_IDS) -> None:
    path = path or default_path()
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    slim = docs.select(ident.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    dealt = slim.repartitionByRange(shuffle_partitions(docs.sparkSession), "id").sortWithinPartitions("id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end], "<u4").tobytes()
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def done() -> pa.RecordBatch:
            nonlocal seq, held
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            file = write_file([i for i, _ in held], [len(x) // 4 for _, x in held], ids)
            row = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()), "file": pa.array([file], pa.binary())}
            seq, held = seq + 1, []
            return pa.record_batch(row)

        size = 0
        for b in batches:
            for i, body in zip(b.column("id").to_pylist(), b.column("body").to_pylist(), strict=True):
                x = enc.encode(body) + tail
                if held and size + len(x) // 4 > file_ids:
                    yield done()
                    size = 0
                held.append((i, x))
                size += len(x) // 4
        if held:
            yield done()

    mapped(dealt, run, "part int, seq int, n_ids long, n_docs long, file binary").write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (ids: binary, little-endian unsigned 32-bit) from the files."""
    files = spark.read.parquet(folder)
    heads = files.select("part", "seq", "n_ids")
    # one row a file of millions of ids: parts are summed first, then files within their part
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts.select("part", "first"), "part").select("part", "seq", (F.col("first") + F.col("before")).alias("base"))
    starts = materialise(starts, "starts")  # its true size decides how it is joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("file").to_pylist(), strict=True):
                docs, lengths, ids = read_file(data)
                raw, n = ids.tobytes(), lengths.astype(np.int64)
                end = np.cumsum(n)
                cuts = list(zip((4 * (end - n)).tolist(), (4 * end).tolist(), strict=True))
                out = {
                    "part": pa.array([part] * len(docs), pa.int32()), "seq": pa.array([seq] * len(docs), pa.int32()), "doc_id": pa.array([None if d == LAST_ID else d for d in docs.tolist()], pa.int64()),
                    "within": pa.array(end - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in cuts], pa.int64()),
                }
                yield pa.record_batch(out | ({"ids": pa.array([raw[x:y] for x, y in cuts], pa.binary())} if with_ids else {}))

    rows = mapped(files.select("part", "seq", "file"), run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
