"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

Fingerprint: texts are lower-cased (A-Z), cut into words and word shingles, and
a bit is set if it is set in over half the shingles' XXH64. Fingerprints link
at ``DISTANCE`` or fewer differing bits; documents are in one component if links
connect them.

Everything after the fingerprints works on distinct fingerprints, so a group of
copies is one row. A fingerprint is cut into blocks: of b blocks, at least
b - DISTANCE agree for a linked pair, so the pair meets under a key of
b - DISTANCE blocks. The number of blocks follows the number of fingerprints
(``key_blocks``) so that chance meetings stay few per key at any size; every
choice finds every link.

A dense group must not give all its pairs. So links are made in two steps:
first every fingerprint of a key is compared with three pivots of the key (the
one with most documents, the smallest, the largest) and components are formed;
then the members of a key are joined, and only pairs are made that are within
the distance and not yet in one component. Together they leave the components
that all links would.

Nulls: a null or wordless text has fingerprint zero, which links like any
other. A null doc_id is in the component of its fingerprint but never names it
unless no id is there (then null). Repeated rows each get a row. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialise, scratch

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: (most fingerprints, blocks): keys of 21, 27 and 32 bits.
LADDER = ((1 << 26, 6), (1 << 32, 7), (1 << 62, 8))
SLICE = 100_000


def _votes(shingles: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, bit 63 first."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(shingles), SLICE):
        part = shingles[i : i + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    words = body.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-shingle]]).tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(begins, ends, strict=True)), np.uint64, len(begins))
    bits = 2 * _votes(hashes) > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fingerprint(x or b"", shingle) for x in b.column("body").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return mapped(slim, run, "doc_id long, fp long")


def key_blocks(n: int) -> int:
    return next(b for most, b in LADDER if n <= most)


def block_keys(fp: Column, blocks: int, distance: int = DISTANCE) -> Column:
    """An array of (combination of blocks, their bits)."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for c, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(c).alias("c"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*out)


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def components(edges: DataFrame) -> DataFrame:
    """node, root of the nodes of ``edges`` (a, b): the same root for all that edges connect.

    Contraction: every node moves to the one of its neighbours and itself that
    has most neighbours, the first in a random order (new each round) among
    equals, and edges follow. A node and the one that it moves to stay connected,
    since their own edge follows too. Only nodes that are first for some
    neighbour are left: stars and dense groups collapse at once, and on chains
    the random order leaves a constant share, so rounds grow with a logarithm.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while e.limit(1).count():
        ways = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("w")).select("w.*")
        many = ways.groupBy("u").agg(F.count("*").alias("n")).select(F.col("u").alias("x"), F.struct((-F.col("n")).alias("n"), F.xxhash64("u", F.lit(len(moves))).alias("h"), F.col("u").alias("v")).alias("r"))
        best = ways.join(many, F.col("v") == F.col("x")).groupBy("u").agg(F.min("r").alias("best"))
        move = best.join(many, F.col("u") == F.col("x")).select("u", F.least("best", "r")["v"].alias("to"))
        move = materialise(move, "moves")
        moves.append(move)
        at = lambda c: move.select(F.col("u").alias(f"u_{c}"), F.col("to").alias(f"to_{c}"))  # noqa: E731, B023
        e = e.join(at("a"), F.col("a") == F.col("u_a")).join(at("b"), F.col("b") == F.col("u_b")).where("to_a <> to_b")
        e = materialise(e.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct(), "edges")
    if not moves:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        out = move.join(out, F.col("to") == F.col("node"), "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root"))
    return out


def linked(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, root for ``nodes`` (fp distinct, n documents): links within ``distance`` bits connect; root is a member of the component."""
    blocks = key_blocks(nodes.count())
    keyed = nodes.withColumn("k", F.explode(block_keys(F.col("fp"), blocks, distance))).select("k.c", "k.key", "fp", "n")
    pivots = keyed.groupBy("c", "key").agg(F.count("*").alias("m"), F.array(F.max_by("fp", F.struct("n", "fp")), F.min("fp"), F.max("fp")).alias("pivots")).where("m > 1")
    close = F.filter("pivots", lambda p: (p != F.col("fp")) & (apart(p, F.col("fp")) <= distance))
    first = components(keyed.join(pivots, ["c", "key"]).select(F.col("fp").alias("a"), F.explode(close).alias("b")))
    of = lambda d: materialise(nodes.join(d, nodes["fp"] == d["node"], "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "nodes")
    placed = of(first)
    keyed = placed.withColumn("k", F.explode(block_keys(F.col("fp"), blocks, distance))).select("k.c", "k.key", "fp", "root")
    other = keyed.select(*[F.col(x).alias(f"o_{x}") for x in keyed.columns])
    met = (F.col("c") == F.col("o_c")) & (F.col("key") == F.col("o_key")) & (F.col("fp") < F.col("o_fp")) & (F.col("root") != F.col("o_root")) & (apart(F.col("fp"), F.col("o_fp")) <= distance)
    more = components(keyed.join(other, met).select(F.col("root").alias("a"), F.col("o_root").alias("b")))
    more = more.select(F.col("node").alias("m_node"), F.col("root").alias("m_root"))
    return placed.join(more, F.col("root") == F.col("m_node"), "left").select("fp", F.coalesce("m_root", "root").alias("root"))


def near_groups(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    prints = materialise(fingerprints(docs, text, shingle), "fps", keep=True)
    with scratch(docs.sparkSession):
        nodes = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "nodes")
        roots = linked(nodes.select("fp", "n"), distance).withColumnRenamed("fp", "r_fp")
        member = nodes.join(roots, F.col("fp") == F.col("r_fp")).select("fp", "least", "root")
        # stored, so that both sides are dealt out for the join alone and a large component can be split
        named = materialise(member.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "n_root"), "roots")
        member = materialise(member.join(named, F.col("root") == F.col("n_root")).select(F.col("fp").alias("m_fp"), "component_id"), "members", keep=True)
    return prints.join(member, F.col("fp") == F.col("m_fp")).select("doc_id", "fp", "component_id")


def near_deduplicated(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id, with the columns of ``docs``.

    Wordless documents are copies of one another. Rows
    that share a doc_id stay or go together; a document without an id stays.
    """
    groups = near_groups(docs, text, shingle, distance)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
