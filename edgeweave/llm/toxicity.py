"""Toxicity by compression distance.

Two zstandard dictionaries stand for toxic and for ordinary text; each is
trained on windows of its class. In front of both lies nothing but their own
part: the rest, trained on ordinary text, is shared, so that common language
costs the same with either and differences come from the classes' own parts.

Only some windows of a toxic text are toxic. So a class's part is trained twice:
first on those of its windows that the shared part compresses worst, then on
those of its windows that compress best with the toxic dictionary of the first
round as against the ordinary one. For the ordinary class these are the windows
that look most toxic, and training on them takes such matches back.

A text is cut into overlapping windows of ``WINDOW`` bytes; each is compressed
with both dictionaries, and its distance is by how many bytes the toxic one does
better. The text's distance is the sum of what exceeds ``MARGIN`` over the
square root of the number of windows. Distances are calibrated to probabilities
on labelled rows apart from those that the dictionaries come from: counts per
distance step, made monotone (pool adjacent violators).

The dictionaries come from a bounded sample (``TRAIN_TOXIC`` and
``TRAIN_ORDINARY`` documents of at most ``TRAIN_BYTES`` bytes, the first in the
order of a hash of the id, of two thirds of the ids); the calibration covers all
other labelled rows. Rows whose crc32(doc_id) mod 4 is 2 are never learned from.
Only the text enters a score.

Nulls and empty texts have distance 0 and get its probability. Texts of any
length are read whole. Labels that are null or contradict each other are left
out. Where labels of a class are lacking, its part is empty; without labels to
calibrate on every score is 0.0. Repeated rows get a score each. Only the
columns named are returned, so other columns can't clash. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialise

TRAIN_TOXIC = 2000
TRAIN_ORDINARY = 4000
TRAIN_BYTES = 20_000
#: Bytes of the shared part, its segments and the number and size of the windows it is trained on.
SHARED, SHARED_SEGMENT, SHARED_WINDOWS, SHARED_WINDOW = 131_072, 200, 40_000, 96
#: Bytes of a class's own part, its segments, and the length of the byte strings counted in training.
OWN, SEGMENT, STRING = 4096, 12, 8
#: Shares of a class's windows that the first and the second round train on.
FIRST_SHARE, SECOND_SHARE = 0.3, 0.05
WINDOW = 32
STEP = 16
LEVEL = 6
MARGIN = 2
#: Distances are kept in steps of 1 / SCALE, up to HIGH.
SCALE, HIGH = 16, 60
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def windows(text: bytes, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    return [text[i : i + size] for i in range(0, max(1, len(text)), step)]


def trained(samples: list[bytes], size: int, segment: int, string: int = STRING) -> bytes:
    """The content of a dictionary trained on ``samples``; the samples themselves where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size + 400, samples, k=segment, d=string).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def coder(dictionary: bytes):
    """Compresses with ``dictionary``."""
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False).compress


def _highest(samples: list[bytes], marks: np.ndarray, share: float) -> list[bytes]:
    """The ``share`` of ``samples`` (300 at least) with the highest marks, in their order."""
    n = min(len(samples), max(300, int(len(samples) * share)))
    return [samples[i] for i in np.sort(np.argsort(-marks, kind="stable")[:n]).tolist()]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary, from lower-cased texts of the classes."""
    every = [w for t in ordinary[::2] for w in windows(t, SHARED_WINDOW, SHARED_WINDOW)]
    shared = trained(every[:: max(1, len(every) // SHARED_WINDOWS)], SHARED, SHARED_SEGMENT)
    plain = coder(shared)
    classes = [[w for t in texts for w in windows(t) if len(w) == WINDOW] for texts in (toxic, ordinary[1::2])]
    own = [trained(_highest(x, np.array([len(plain(w)) for w in x], np.int32), FIRST_SHARE), OWN, SEGMENT) for x in classes]
    bad, good = (coder(part + shared) for part in own)
    own = [trained(_highest(x, np.array([len(good(w)) - len(bad(w)) for w in x], np.int32), SECOND_SHARE), OWN, SEGMENT) for x in classes]
    return own[0] + shared, own[1] + shared


class Distance:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = coder(toxic), coder(ordinary)

    def of(self, body: bytes) -> float:
        toxic, ordinary, cut = self.toxic, self.ordinary, windows(body.lower())
        gains = [len(ordinary(w)) - len(toxic(w)) - MARGIN for w in cut]
        return sum(g for g in gains if g > 0) / sqrt(len(cut))


def distances(docs: DataFrame, toxic: bytes, ordinary: bytes, text: str = "text") -> DataFrame:
    """doc_id, bin: the distance in steps of 1 / SCALE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Distance(toxic, ordinary)
        for b in batches:
            d = np.array([measure.of(x or b"") for x in b.column("body").to_pylist()], float)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "bin": pa.array(np.rint(np.minimum(d, HIGH) * SCALE).astype(np.int32), pa.int32())})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return mapped(slim, run, "doc_id long, bin int")


def monotone(seen: list[int], toxic: list[int]) -> list[float]:
    """Non-decreasing probabilities per bin; bins without rows take those of the nearest bin below (else above)."""
    pools: list[list[float]] = []
    where = []
    for i, (n, k) in enumerate(zip(seen, toxic, strict=True)):
        if not n:
            continue
        where.append(i)
        pools.append([n, k, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n1, k1, m1 = pools.pop()
            pools[-1] = [pools[-1][0] + n1, pools[-1][1] + k1, pools[-1][2] + m1]
    values = [k / n for n, k, m in pools for _ in range(m)]
    if not values:
        return [0.0] * len(seen)
    at = np.searchsorted(np.array(where), np.arange(len(seen)), "right") - 1
    return [values[max(0, i)] for i in at.tolist()]


def clear_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labels that learning may see."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__hi")).where("toxic = __hi").drop("__hi")


def training_ids(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, toxic of at most ``TRAIN_TOXIC`` + ``TRAIN_ORDINARY`` documents; two thirds of the ids may be among them."""
    mark = F.xxhash64("doc_id")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).alias("n")).where(f"n > 0 and n <= {TRAIN_BYTES}").select("doc_id")
    rows = labels.where(F.pmod(mark, F.lit(3)) != 0).join(sizes, "doc_id", "left_semi")
    of = lambda toxic, most: rows.where(F.col("toxic") == toxic).orderBy(mark, "doc_id").limit(most)
    return of(1, TRAIN_TOXIC).unionByName(of(0, TRAIN_ORDINARY))


def training_texts(docs: DataFrame, ids: DataFrame, text: str = "text") -> tuple[list[bytes], list[bytes]]:
    """The distinct lower-cased (toxic, ordinary) texts of ``ids``, in the order of a hash of the id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body")).where(F.octet_length("body").between(1, TRAIN_BYTES))
    # the ids are bounded by the two limits
    got = slim.join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("h"), "toxic", "body").collect()
    got = sorted((r["h"], bytes(r["body"]).lower(), r["toxic"]) for r in got)
    return tuple(list(dict.fromkeys(body for _, body, toxic in got if toxic == side))[:most] for side, most in ((1, TRAIN_TOXIC), (0, TRAIN_ORDINARY)))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, distance, score, predicted of every document."""
    known = materialise(clear_labels(labels), "labels")
    ids = materialise(training_ids(docs, known, text), "training")
    found = materialise(distances(docs, *dictionaries(*training_texts(docs, ids, text)), text), "distances")
    bins = HIGH * SCALE + 1
    other = known.join(F.broadcast(ids), "doc_id", "left_anti")
    counts = found.join(other, "doc_id").groupBy("bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()  # at most ``bins`` rows
    seen, hits = [0] * bins, [0] * bins
    for r in counts:
        seen[r["bin"]], hits[r["bin"]] = r["n"], r["k"]
    table = F.split(F.lit(",".join(map(repr, monotone(seen, hits)))), ",").cast("array<double>")
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (F.col("bin") / SCALE).alias("distance"), F.get(table, F.col("bin")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
