"""Near copies by the similarity of word shingles: candidates from blocks of SimHash fingerprints, exact check, components.

Texts are lower-cased (A-Z) and cut into words; a text's set is that of its
``SHINGLE``-word shingles (all its words if it has fewer). Texts are linked if
the Jaccard similarity of their sets is ``LEAST`` or more; documents are in one
component if links connect them.

Candidates: SimHash fingerprints over the shingles, cut into blocks. For each bit
a shingle's hash gives a signed weight (the sum of eight entries of a table, one
for each byte: tabulation), and the bit is the sign of the sum over the set. Bits
of two sets differ with the chance angle / pi, where the cosine of the angle is
|A & B| / sqrt(|A| |B|): at a similarity of 0.8 or more it is ``APART`` (0.152) at
most. At that share no number of blocks is sure to leave one alike and still
tells texts apart, as it is for few differing bits (``simhash``). So the
fingerprint is as long as it takes: so many blocks that a pair at exactly 0.8
shares none with a chance of ``MISS``, a closer one with less (``shape``). The
width of a block follows the number of documents; narrow blocks, which need few
keys, have many chance meetings, and ``parts`` divides the members of a key into
those that may link to one another, by ``FIRST`` further bits; each such part is a
place of its own, and members alone in theirs go. Pairs that are left
are compared by the sizes of their sets (exact) and by ``BITS`` bits (at 0.8, 39
differ on average; more than ``MOST`` of them with a chance of about a millionth);
those left are checked on the sets themselves, so that no link is below ``LEAST``.

Texts with equal sets are one node (a 64-bit hash stands for the set). Members of
a place are first held against its hub, then against three pivots, and only then
those pairs are made that are not yet in one component.

Nulls: a null or wordless text has the empty set and is a copy of others like
it. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialise, scratch
from .simhash import apart, components

SHINGLE = 5
LEAST = Fraction(4, 5)
SEED = 42
#: Share of bits in which sets of similarity ``LEAST`` differ at most, and the chance that a pair at it shares no block.
APART = math.acos(2 * LEAST / (1 + LEAST)) / math.pi
MISS = 5e-5
#: (most documents, bits of a block).
LADDER = ((1 << 18, 12), (1 << 22, 14), (1 << 26, 16), (1 << 62, 20))
#: Bits beside the blocks that a pair is held against, and how many may differ: of all, and of the first two longs.
BITS, MOST = 256, 67
FIRST, MOST_FIRST = 128, 41
WORDS = [f"b{i}" for i in range(BITS // 64)]
#: Members of a key that are compared with one another; those of a larger key all stay.
LONG = 2048
#: Members of a group around a text of which all pairs are made.
SMALL = 64
#: Texts whose fingerprints are made at once; bounds the arrays.
SLICE = 256


def shape(documents: int) -> tuple[int, int]:
    """(blocks, bits of a block)."""
    width = next(w for most, w in LADDER if documents <= most)
    return math.ceil(math.log(MISS) / math.log1p(-((1 - APART) ** width))), width


def shingles(body: bytes, shingle: int = SHINGLE) -> set[bytes]:
    words = body.lower().split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-shingle]]).tolist()
    return {text[a:b] for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)}


def similar(a: set[bytes], b: set[bytes], least: Fraction = LEAST) -> bool:
    both = len(a & b)
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


@lru_cache(maxsize=2)
def weights(bits: int) -> np.ndarray:
    """Whole-number weights: a row for each byte of a hash and its low seven bits (the eighth is the sign), a column a bit."""
    return np.rint(np.random.default_rng(SEED).standard_normal((1024, bits), np.float32) * 16)


def fingerprints(hashes: list[np.ndarray], blocks: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of each block, ``BITS`` further bits as longs): a row for each set of ``hashes``."""
    counts = np.zeros((len(hashes), 1024), np.float32)
    at = np.arange(8) * 256
    for i, h in enumerate(hashes):
        n = np.bincount((h.view(np.uint8).reshape(-1, 8) + at).reshape(-1), minlength=2048).reshape(8, 2, 128)
        counts[i] = (n[:, 0] - n[:, 1]).reshape(-1)
    bits = counts @ weights(BITS + blocks * width) > 0
    keys = bits[:, BITS:].reshape(-1, blocks, width).astype(np.float32) @ (2.0 ** np.arange(width, dtype=np.float32))
    return keys.astype(np.int32), np.packbits(bits[:, :BITS], axis=1).view(np.int64)


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row (a hash of the text), node (a hash of the set), size (of the set), keys, and the further bits."""
    blocks, width = shape(docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                b = whole.slice(begin, SLICE)
                sets = [shingles(x or b"") for x in b.column("body").to_pylist()]
                hashes = [np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own))) for own in sets]
                keys, bits = fingerprints(hashes, blocks, width)
                yield pa.record_batch({
                    "doc_id": b.column("doc_id"),
                    "row": b.column("row"),
                    "node": pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in hashes], np.uint64).view(np.int64), pa.int64()),
                    "size": pa.array([len(own) for own in sets], pa.int32()),
                    "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * blocks), pa.array(keys.reshape(-1))),
                    **{c: pa.array(np.ascontiguousarray(bits[:, k])) for k, c in enumerate(WORDS)},
                })

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).cast("binary").alias("body"))
    return mapped(slim, run, "doc_id long, row long, node long, size int, keys array<int>, " + ", ".join(f"{c} long" for c in WORDS))


def parts(slot: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """For each row the first row of its part of the slot, or -1 if it is alone; ``slot`` is sorted.

    Rows of a slot that differ in few of the first bits are in one part, also if only others connect them. A slot with over ``LONG`` rows is one part.
    """
    if not len(slot):
        return np.zeros(0, np.int64)
    b0, b1 = b0.view(np.uint64), b1.view(np.uint64)  # of a signed number numpy counts the bits of the absolute value
    edges = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))
    lengths = np.diff(edges)
    large = np.repeat(lengths > LONG, lengths)
    first, last = np.where(large, np.repeat(edges[:-1], lengths), np.arange(len(slot))), np.repeat(edges[1:], lengths)
    i = np.flatnonzero(~large)
    for d in range(1, int(lengths[lengths <= LONG].max(initial=0))):
        i = i[i + d < last[i]]
        a = i[first[i] != first[i + d]]
        a = a[np.bitwise_count(b0[a] ^ b0[a + d]) + np.bitwise_count(b1[a] ^ b1[a + d]) <= MOST_FIRST]
        b = a + d
        while len(a):
            u, v = first[a], first[b]
            np.minimum.at(first, np.maximum(u, v), np.minimum(u, v))
            while not np.array_equal(up := first[first], first):
                first = up
            a, b = a[(open_ := first[a] != first[b])], b[open_]
    return np.where(np.bincount(first, minlength=len(first))[first] > 1, first, -1)


def gatherings(nodes: DataFrame) -> DataFrame:
    """c, key, node, place: the members of a key of which another member may be similar; members that may be similar share a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[np.ndarray], part: np.ndarray) -> pa.RecordBatch:
            keep = part >= 0
            slot, part = rows[0][keep], part[keep]
            sizes = np.bincount(part, minlength=len(keep))  # a long slot, also one that goes on, has no name but its own
            name = np.where(sizes[part] > LONG, 0, rows[1][part])
            return pa.record_batch({"slot": slot, "part": name, "node": rows[1][keep]})

        rest, large = [np.zeros(0, np.int64)] * 4, None
        for b in batches:
            rest = [np.concatenate([r, b.column(k).to_numpy()]) for k, r in enumerate(rest)]
            slot = rest[0]
            if not len(slot):
                continue
            known = np.searchsorted(slot, large, "right") if large is not None else 0
            if known:
                yield pa.record_batch({"slot": slot[:known], "part": np.zeros(known, np.int64), "node": rest[1][:known]})
            begin = max(known, np.searchsorted(slot, slot[-1]))
            ended = [r[known:begin] for r in rest]
            yield told(ended, parts(ended[0], *ended[2:]))
            if len(slot) - begin > LONG:  # goes on in the next batch; all that come have as many beside them
                large = slot[-1]
                yield pa.record_batch({"slot": slot[begin:], "part": np.zeros(len(slot) - begin, np.int64), "node": rest[1][begin:]})
                begin = len(slot)
            rest = [r[begin:] for r in rest]
        yield told(rest, parts(rest[0], *rest[2:]))

    keyed = nodes.select(F.posexplode("keys").alias("c", "key"), "node", "b0", "b1")
    keyed = keyed.select((F.shiftleft(F.col("c").cast("long"), 32) + F.col("key")).alias("slot"), "node", "b0", "b1")
    met = mapped(keyed.repartition("slot").sortWithinPartitions("slot"), run, "slot long, part long, node long")
    return met.select(F.shiftright("slot", 32).cast("int").alias("c"), F.col("slot").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("key"), "node", F.xxhash64("slot", "part").alias("place"))


def meetings(nodes: DataFrame) -> DataFrame:
    """c, key, node: the members of a key of which another member may be similar."""
    return gatherings(nodes).select("c", "key", "node")


def _may_link(a, b) -> Column:
    """Whether sizes and bits allow a link; ``a`` and ``b`` give a column by its name."""
    sizes = F.least(a("size"), b("size")) * LEAST.denominator >= F.greatest(a("size"), b("size")) * LEAST.numerator
    return sizes & (sum((apart(a(c), b(c)) for c in WORDS), F.lit(0)) <= MOST)


def texts_of(nodes: DataFrame, prints: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """node, body: a text of each of ``nodes`` (node, maybe repeated). The documents are dealt out once for all that is compared."""
    asked = nodes.select(F.col("node").alias("t_node")).distinct()
    reps = prints.join(asked, F.col("node") == F.col("t_node"), "left_semi").groupBy("node").agg(F.min("row").alias("t_row"))
    texts = docs.select(F.xxhash64(text).alias("row"), F.col(text).cast("binary").alias("body")).join(reps, F.col("row") == F.col("t_row"))
    return materialise(texts.groupBy("node").agg(F.min("body").alias("body")), "texts")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b: nodes) with body_a, body_b."""
    of = lambda c: texts.select(F.col("node").alias(f"n_{c}"), F.col("body").alias(f"body_{c}"))
    return pairs.join(of("a"), F.col("a") == F.col("n_a")).join(of("b"), F.col("b") == F.col("n_b")).select("a", "b", "body_a", "body_b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b: nodes) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, last, own = [], None, set()
            for x, y in zip(b.column("body_a").to_pylist(), b.column("body_b").to_pylist(), strict=True):
                if x != last:
                    last, own = x, shingles(x or b"")
                ok.append(similar(own, shingles(y or b"")))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return mapped(with_texts(pairs, texts), run, "a long, b long")


def sets_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """s_node, own (hashes of its shingles) of ``nodes`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(x or b"")], np.uint64).view(np.int64) for x in b.column("body").to_pylist()]
            yield pa.record_batch({"s_node": b.column("node"), "own": pa.array(own, pa.list_(pa.int64()))})

    return mapped(texts.join(nodes.select(F.col("node").alias("t_node")), F.col("node") == F.col("t_node"), "left_semi"), run, "s_node long, own array<long>")


def common_sets(sets: DataFrame) -> DataFrame:
    """c_hub, common: shingles that about t = max(``SMALL``, 8 sqrt(members)) or more of a group's ``sets`` (hub, members, own) have.

    A batch tells the counts over its share of t only; what is not told adds up to
    t at most. So those over t / 2 are all that more than 1.5 t members have, and
    none that t / 2 or fewer have. What a group's common set is affects only which
    pairs are made, never the links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, hubs = b.column("own"), b.column("hub").to_numpy()
            names, group, here = np.unique(hubs, return_inverse=True, return_counts=True)
            t = np.zeros(len(names))
            t[group] = np.maximum(SMALL, 8 * np.sqrt(b.column("members").to_numpy()))
            least = np.zeros(len(names))
            least[group] = t[group] * here[group] / b.column("members").to_numpy()
            g, h = np.repeat(group, own.value_lengths().to_numpy()), own.flatten().to_numpy()
            order = np.lexsort((h, g))
            g, h = g[order], h[order]
            begins = np.flatnonzero(np.concatenate([[len(h) > 0], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(begins, len(h)))
            told = n > least[g[begins]]
            at = begins[told]
            yield pa.record_batch({"hub": names[g[at]], "h": h[at], "n": n[told], "t": t[g[at]]})

    told = mapped(sets.select("hub", F.col("members").cast("long").alias("members"), "own"), run, "hub long, h long, n long, t double")
    told = told.groupBy("hub", "h").agg(F.sum("n").alias("n"), F.first("t").alias("t")).where("2 * n > t")
    return told.groupBy(F.col("hub").alias("c_hub")).agg(F.collect_set("h").alias("common"))


def remaining_pairs(met: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: the pairs of ``nodes`` (node, size, bits, root, hub) that share a place of ``met`` (place, k_node), lie in different components and may be similar.

    In a group around a common text most pairs are too far apart, and their
    number is the square of the group's. So each node belongs to the group of
    the hub it meets most, and places count only for pairs of different groups and
    for those of a large group that its common set makes possible. Of a group of at most ``SMALL`` all pairs are made; a
    larger one has a common set (``common_sets``): the shingles that more than some
    8 sqrt(n) (and over ``SMALL``) of its n members have. Two sets that share nothing beside the
    common set share at most what each has of it; where that is too little, they
    can't be similar. Hence pairs of one large group are made only if it is
    enough, or from a shingle that both have beside the common set, which no more
    than so many members have. Of those shingles the first in the order of their
    hashes do: sets that must share ``need`` of them share one before the last
    ``need`` - 1 of either (prefix filter).
    """
    many = nodes.groupBy(F.col("hub").alias("m_hub")).agg(F.count("*").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").drop("lo", "hi")
    groups = materialise(nodes.join(many, F.col("hub") == F.col("m_hub")).drop("m_hub"), "grouped")
    small, large = groups.where(F.col("members") <= SMALL), groups.where(F.col("members") > SMALL)
    sets = large.select("node", "hub", "members", "size").join(sets_of(large, texts), F.col("node") == F.col("s_node")).drop("s_node")
    sets = materialise(sets, "sets")
    common = materialise(common_sets(sets), "common")
    none = F.array().cast("array<bigint>")
    near = sets.join(common, F.col("hub") == F.col("c_hub"), "left").withColumn("common", F.coalesce("common", none))
    near = near.select(F.col("node").alias("s_node"), "size", F.size(F.array_intersect("own", "common")).alias("both"), F.array_sort(F.array_except("own", "common")).alias("beside"))
    need = F.greatest(F.lit(1), F.ceil(F.col("size") * LEAST.numerator / LEAST.denominator) - F.col("both"))
    ahead = F.greatest(F.lit(0), F.size("beside") - need + 1).cast("int")
    near = materialise(near.select("s_node", "both", F.slice("beside", F.lit(1), ahead).alias("ahead")), "near")
    cols = ["node", "size", *WORDS, "root", "hub", "both"]
    apart_yet = (F.col("node") < F.col("o_node")) & (F.col("root") != F.col("o_root")) & _may_link(F.col, lambda k: F.col(f"o_{k}"))
    other = lambda d: d.select(*[F.col(x).alias(f"o_{x}") for x in d.columns])
    made = lambda d, by: d.join(other(d), by & apart_yet).select(F.col("node").alias("a"), F.col("o_node").alias("b"))
    same_hub, on_place = F.col("hub") == F.col("o_hub"), F.col("place") == F.col("o_place")
    enough = F.least("both", "o_both") * (LEAST.numerator + LEAST.denominator) >= (F.col("size") + F.col("o_size")) * LEAST.numerator
    held = nodes.join(near.select("s_node", "both"), F.col("node") == F.col("s_node"), "left").withColumn("both", F.coalesce("both", F.lit(0)))
    held = materialise(held.select(*cols), "held")
    ends = met.join(held.select("node", "root", "hub"), F.col("k_node") == F.col("node"))
    ends = ends.groupBy(F.col("place").alias("s_place")).agg(*[f(c).alias(f"{n}_{c}") for c in ("root", "hub") for n, f in (("lo", F.min), ("hi", F.max))])
    ends = materialise(ends.where("lo_root <> hi_root").select("s_place", (F.col("lo_hub") != F.col("hi_hub")).alias("mixed")), "ends")
    # a pair for which the common set is enough differs in size by LEAST at most
    able = F.col("both") * LEAST.denominator >= F.col("size") * LEAST.numerator
    keyed = met.join(held, F.col("k_node") == F.col("node")).join(ends, (F.col("place") == F.col("s_place")) & (F.col("mixed") | able))
    keyed = materialise(keyed.select("place", *cols), "keyed")
    beside = materialise(large.join(near, F.col("node") == F.col("s_node")).select(*cols, F.explode("ahead").alias("h")), "beside")
    by_key = made(keyed, on_place & (~same_hub | enough))
    by_own = made(beside, same_hub & (F.col("h") == F.col("o_h")))
    return by_key.unionByName(by_own).unionByName(made(small.select(*[c for c in cols if c != "both"]), same_hub)).distinct()


def merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` (node, root) with the components joined that ``links`` (a, b: nodes) connect."""
    to = lambda c: placed.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}"))
    edges = links.join(to("a"), F.col("a") == F.col("n_a")).join(to("b"), F.col("b") == F.col("n_b")).select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))
    last = components(edges).select(F.col("node").alias("l_node"), F.col("root").alias("l_root"))
    return materialise(placed.join(last, F.col("root") == F.col("l_node"), "left").select("node", F.coalesce("l_root", "root").alias("root")), "placed")


def linked(nodes: DataFrame, prints: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """node, root of all nodes: the same root for all that links connect.

    First a node is held against the hub that it meets most, then members of a
    place against its pivots unless they are connected, then the pairs that are left.
    """
    cols = ["node", "size", *WORDS]
    here = F.col("place") == F.col("s_place")
    met = materialise(gatherings(nodes).select("place", "node"), "meetings")
    shared = materialise(met.groupBy(F.col("place").alias("s_place")).agg(F.count("*").alias("m")).where("m > 1"), "keys")
    met = materialise(met.withColumnRenamed("node", "k_node").join(nodes.select(*cols), F.col("k_node") == F.col("node")).join(shared, here).select("place", *cols, "m"), "met")
    # the text that most others resemble meets most of them: as a pivot of all its places it gathers a group around it
    popular = met.groupBy(F.col("node").alias("v_node")).agg(F.sum("m").alias("met"))
    met = materialise(met.join(popular, F.col("node") == F.col("v_node")).select("place", *cols, "met"), "met")
    own = F.struct(*cols, "met")
    hubs = met.groupBy(F.col("place").alias("s_place")).agg(F.max_by(own, F.struct("met", "node")).alias("hub"))
    met = materialise(met.join(hubs, here).select("place", *cols, "met", "hub"), "met")
    rank = F.struct("hub.met", "hub.node")
    close = (F.col("hub.node") != F.col("node")) & _may_link(lambda k: F.col("hub")[k], F.col)
    gathered = met.groupBy("node").agg(*[F.first(c).alias(c) for c in cols[1:]], F.max_by("hub.node", rank).alias("hub"), F.max_by(F.when(close, F.col("hub.node")), F.when(close, rank)).alias("other"))
    gathered = materialise(gathered, "gathered")
    texts = texts_of(gathered, prints, docs, text)
    placed = merged(nodes.select("node", F.col("node").alias("root")), verified(gathered.where("other is not null").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), texts))

    rooted = lambda: met.select("place", *cols, "met").join(placed.select(F.col("node").alias("p_node"), "root"), F.col("node") == F.col("p_node")).drop("p_node")
    mine = materialise(rooted(), "rooted")
    own = F.struct(*cols, "met", "root")
    pivots = mine.groupBy(F.col("place").alias("s_place")).agg(F.array(F.max_by(own, F.struct("met", "node")), F.min(own), F.max_by(own, F.struct("size", "node"))).alias("pivots"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    close = F.filter("pivots", lambda p: (p["root"] != F.col("root")) & _may_link(lambda k: p[k], F.col))
    others = F.transform(close, lambda p: p["node"])
    pairs = mine.join(pivots.where("lo <> hi").drop("lo", "hi"), here & (F.size(others) > 0)).select("node", F.explode(others).alias("other"))
    pairs = pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    placed = merged(placed, verified(pairs, texts))

    grouped = gathered.drop("other").join(placed.select(F.col("node").alias("p_node"), "root"), F.col("node") == F.col("p_node")).drop("p_node")
    return merged(placed, verified(remaining_pairs(met.select("place", F.col("node").alias("k_node")), materialise(grouped, "open-nodes"), texts), texts))


def near_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row, root of every row: rows in one component have one root."""
    prints = materialise(sketches(docs, text), "sketches")
    slim = prints.select("doc_id", "row", "node")
    nodes = materialise(prints.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "keys", *WORDS)]), "nodes")
    roots = linked(nodes, slim, docs, text).withColumnRenamed("node", "r_node")
    return materialise(slim.join(roots, F.col("node") == F.col("r_node")).select("doc_id", "row", "root"), "rooted")


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row, component_id (the smallest doc_id that links reach) of every row."""
    rows = near_components(docs, text)
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "root").select("doc_id", "row", "component_id")


def without_near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with the columns of ``docs``.

    Rows without an id come after all others; of rows that share the id the one
    with the smallest text hash stays, of rows that share both the smallest in
    the order of all columns.
    """
    with scratch(docs.sparkSession):
        rows = near_components(docs, text)
        rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        best = rows.groupBy("root").agg(F.min_by(F.struct(F.col("doc_id").alias("k_id"), F.col("row").alias("k_row")), rank).alias("k")).select("root", "k.*")
        times = rows.groupBy("doc_id", "row").agg(F.count("*").alias("n"))
        best = materialise(best.join(times, F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_row") == F.col("row"))).select("k_id", "k_row", "n"), "kept", keep=True)
    of = lambda d: F.col("doc_id").cast("long").eqNullSafe(d["k_id"]) & (F.xxhash64(text) == d["k_row"])
    once, again = best.where("n = 1"), best.where("n > 1")
    out = docs.join(once, of(once), "left_semi")
    repeated = docs.join(again, of(again), "left_semi")
    repeated = repeated.groupBy(F.col("doc_id").alias("g_id"), F.xxhash64(text).alias("g_row")).agg(F.min(F.struct(*docs.columns)).alias("d")).select("d.*")
    return out.unionByName(repeated).select(*docs.columns)
