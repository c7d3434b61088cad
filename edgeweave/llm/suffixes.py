"""Suffix-array dedup: repeated 100-byte strings, found by sorting suffixes in range partitions.

Every byte covered by a ``LENGTH``-byte string of one document that also starts
earlier (smaller doc_id, or same document and earlier start) is removed;
strings are judged on the input. A suffix is a start of such a string, compared
over its first ``LENGTH`` bytes.

Sorting every suffix of a corpus would move many times its size, so suffixes
that cannot repeat, or whose answer is known, leave before the sort:

1. The anchor of a suffix is the ``GRAM``-byte gram with the smallest hash in
   its first ``LENGTH`` bytes (the leftmost one among equals). Equal suffixes
   have equal anchors at equal offsets. Consecutive suffixes with one anchor
   form a span; its context is all bytes they compare.
2. Chunks exchange (anchor hash, context hash) lists. An anchor with one context
   only, first seen here: its suffixes are first occurrences. A context that an
   earlier chunk (or an earlier place in this one) holds: its suffixes are
   repeats. What is left are first contexts whose anchor has other contexts too.
3. Only the suffixes of those are sorted. Sampled splitters cut their order by
   leading bytes into ranges. Each chunk sorts its suffixes word by word
   (multikey: by the first eight bytes, then, among equals, by the rest, which
   a 64-bit hash of all ``LENGTH`` bytes stands for) and sends each range its
   distinct suffixes; a range merges the sorted lists and compares neighbours
   across chunk boundaries. Splitters are whole keys, so equal suffixes never
   straddle a range boundary, and a suffix that a third of all documents share
   arrives once a chunk.

Hashes are polynomials modulo 2^64 in randomised byte values, scrambled. A pair
of 64-bit hashes stands for a context; eight bytes and a 64-bit hash for a suffix.

Nulls and empty texts: no bytes, nothing removed. A null doc_id stands after all
others; rows with one doc_id are ordered by text and each counts as a document.
Bytes need not be valid UTF-8. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import chunks as C
from .common import WORD, leanly, shuffle_partitions, small_batches
from .windows import SPANS

LENGTH = 100
GRAM = 40
BASE = 0x9E3779B97F4A7C15
#: Texts are worked on in blocks of at most so many bytes, so that arrays stay small.
BLOCK = 1 << 19
#: Bits of a place in a block.
PLACE = 20
#: Documents, and characters of each, whose suffixes the splitters are sampled from; they even out the ranges and change no result.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 4000
OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:int,end:int>>, kept binary"
KINDS = "kind int, b int, g int, data binary"


def _constants() -> tuple[np.ndarray, int]:
    table = C.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return table, pow(BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers of the base and of its inverse, up to the longest block.
_POWERS: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(n, BASE), _powers(n, _constants()[1])]
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashes:
    """Prefix sums of a block's bytes, from which every substring's hash follows."""

    def __init__(self, bodies: list[bytes]):
        self.raw = np.frombuffer(b"".join(bodies), np.uint8)
        powers, self.inverse = _powers_to(max(BLOCK + LENGTH, len(self.raw)) + 1)
        self.sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_constants()[0][self.raw] * powers[: len(self.raw)], out=self.sums[1:])

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def every(self, size: int) -> np.ndarray:
        """The hash at every place that ``size`` bytes follow."""
        n = len(self.raw) - size + 1
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n]


class Spans:
    """The spans of a block of documents: anchors, contexts and the suffixes in between (lo to hi).

    Only what is kept for every span stays in memory; ``suffixes`` hashes the block again.
    """

    def __init__(self, bodies: list[bytes], base: int = 0, length: int = LENGTH, gram: int = GRAM):
        self.bodies, self.base, self.length = bodies, base, length
        ends = np.cumsum([len(b) for b in bodies]).astype(np.int64)
        n = int(ends[-1]) if len(ends) else 0
        self.lo = self.hi = np.zeros(0, np.int32)
        self.gram = self.context = np.zeros(0, np.uint64)
        if n < length:
            return
        hashes = Hashes(bodies)
        grams = C.mix(hashes.every(gram))
        # the smallest leading bits and then the leftmost place, in one number: PLACE is fixed, so that the anchor is a matter of the suffix alone
        key = grams & ~np.uint64((1 << PLACE) - 1)
        key |= np.arange(len(grams), dtype=np.uint64)
        width, least = length - gram + 1, 1
        while 2 * least <= width:
            key = np.minimum(key[:-least], key[least:])
            least *= 2
        if least < width:
            key = np.minimum(key[: len(key) - (width - least)], key[width - least :])
        key &= np.uint64((1 << PLACE) - 1)
        anchor = key.astype(np.int32)
        fits = np.ones(len(anchor), bool)
        for e in ends[:-1].tolist():
            fits[max(0, e - length + 1) : e] = False
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~fits[:-1]
        new &= fits
        last = np.ones(len(anchor), bool)
        last[:-1] = new[1:] | ~fits[1:]
        last &= fits
        lo, hi = np.flatnonzero(new), np.flatnonzero(last)
        mid = anchor[lo].astype(np.int64)
        self.gram = C.mix(grams[mid])  # smallest hashes lie close together: scrambled once more they spread evenly over the buckets
        self.context = C.mix(hashes.of(lo, hi + length - lo) ^ ((mid - lo).astype(np.uint64) << np.uint64(32)) ^ (hi - lo).astype(np.uint64))
        self.lo, self.hi = lo.astype(np.int32), hi.astype(np.int32)

    def suffixes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, first eight bytes as a number, hash of all bytes) of the suffixes of the spans ``which``."""
        lo, hi = self.lo[which].astype(np.int64), self.hi[which].astype(np.int64)
        size = hi - lo + 1
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        lead = np.zeros(len(at), np.uint64)
        if not len(at):
            return at, lead, lead.copy()
        hashes = Hashes(self.bodies)
        for k in range(8):
            lead = (lead << np.uint64(8)) | hashes.raw[at + k].astype(np.uint64)
        return at, lead, C.mix(hashes.of(at, self.length))


def _blocks(bodies: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """(first byte, texts) of blocks of about ``BLOCK`` bytes; a longer text is cut into pieces that overlap by a suffix."""
    out, held, size, at = [], [], 0, 0
    for b in bodies:
        if held and size + len(b) > BLOCK:
            out.append((at - size, held))
            held, size = [], 0
        if len(b) > BLOCK:
            out += [(at + i, [b[i : i + BLOCK + LENGTH - 1]]) for i in range(0, len(b) - LENGTH + 1, BLOCK)]
        else:
            held.append(b)
            size += len(b)
        at += len(b)
    if held:
        out.append((at - size, held))
    return out


class Chunk:
    """A chunk's spans, with the distinct (anchor, context) pairs in order."""

    def __init__(self, bodies: list[bytes]):
        self.parts = [Spans(b, base) for base, b in _blocks(bodies)]
        self.total = sum(map(len, bodies))
        none = [np.zeros(0, np.uint64)]
        gram = np.concatenate([p.gram for p in self.parts] or none)
        context = np.concatenate([p.context for p in self.parts] or none)
        for p in self.parts:
            p.gram = p.context = none[0]
        order, same = C.repeats((gram, context))
        self.first = order[~same]
        self.again = np.zeros(len(order), bool)
        self.again[order[same]] = True
        self.pairs = gram[self.first], context[self.first]

    def split(self, flags: np.ndarray) -> list[np.ndarray]:
        """``flags`` of all spans, by part."""
        return np.split(flags, np.cumsum([len(p.lo) for p in self.parts])[:-1])

    def undecided(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of the spans flagged by ``shared``: (places in the chunk's bytes, leads, hashes)."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for p, s in zip(self.parts, self.split(shared), strict=True):
            if s.any():
                at, lead, rest = p.suffixes(np.flatnonzero(s))
                out.append((at + p.base, lead, rest))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def spans_of(self, flags: np.ndarray) -> np.ndarray:
        """Which of the chunk's bytes lie in the suffixes of flagged spans."""
        change = np.zeros(self.total + 1, np.int32)
        for p, f in zip(self.parts, self.split(flags), strict=True):
            if f.any():
                np.add.at(change, p.lo[f] + np.int64(p.base), 1)
                np.add.at(change, p.hi[f] + np.int64(p.length + p.base), -1)
        return np.cumsum(change[:-1], dtype=np.int32) > 0


def multikey_order(lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sorts suffixes by their first word; only runs of equal first words are sorted by what follows. Stable."""
    order = np.argsort(lead, kind="stable")
    s = lead[order]
    tie = np.concatenate([[False], s[1:] == s[:-1]])
    inside = tie | np.concatenate([tie[1:], [False]])
    if inside.any():
        at = np.flatnonzero(inside)
        run = np.cumsum(~tie)[at]
        order[at] = order[at][np.lexsort((rest[order[at]], run))]
    return order


def _sorted_distinct(lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each distinct suffix in order, the others)."""
    order = multikey_order(lead, rest)
    same = np.concatenate([[False], (lead[order][1:] == lead[order][:-1]) & (rest[order][1:] == rest[order][:-1])])[: len(order)]
    return order[~same], order[same]


def _splitters(docs: DataFrame, text: str, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (first word, hash) of the order of suffixes into about equal ranges, from a bounded sample of documents."""
    whole = F.coalesce(F.col(text), F.lit(""))
    place = F.pmod(F.xxhash64(whole), F.greatest(F.lit(1), F.length(whole) - SAMPLE_CHARS)) + 1
    picked = docs.select(F.xxhash64("doc_id").alias("h"), F.substring(whole, place.cast("int"), F.lit(SAMPLE_CHARS)).cast("binary").alias("body"))
    got = picked.orderBy("h").limit(SAMPLE_DOCS).collect()
    parts = [Spans(b) for _, b in _blocks([bytes(r["body"]) for r in got])]
    pairs = [p.suffixes(np.arange(len(p.lo)))[1:] for p in parts if len(p.lo)]
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lead, rest = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((rest, lead))
    pick = order[np.linspace(0, len(order) - 1, ranges + 1).astype(int)[1:-1]]
    return lead[pick], rest[pick]


def _ranges(lead: np.ndarray, rest: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where the ranges between ``cuts`` begin and end in the sorted keys."""
    lo, hi = np.searchsorted(lead, cuts[0], "left"), np.searchsorted(lead, cuts[0], "right")
    inner = [a + int(np.searchsorted(rest[a:b], r)) for a, b, r in zip(lo.tolist(), hi.tolist(), cuts[1], strict=True)]
    return np.concatenate([[0], inner, [len(lead)]]).astype(np.int64)


def whole_characters(body: bytes, mask: np.ndarray) -> np.ndarray:
    """``mask`` of bytes widened to the UTF-8 characters that it touches; a stray byte is one by itself."""
    raw, at = np.frombuffer(body, np.uint8), np.arange(len(body))
    begin = (raw & 0xC0) != 0x80
    lead = np.maximum.accumulate(np.where(begin, at, 0))
    size = np.select([raw >= 0xF0, raw >= 0xE0, raw >= 0xC0], [4, 3, 2], 1)
    begin |= at - lead >= size[lead]
    begin[:1] = True
    char = np.cumsum(begin) - 1
    return np.bincount(char, mask)[char] > 0


def repeated_suffixes(docs: DataFrame, text: str = "text", carry: list[Column] | None = None, whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte intervals) and kept (the other bytes).

    With ``carry``, a struct of those columns of ``docs`` comes along. With
    ``whole``, characters that a cut splits are missing from kept too.
    """
    small_batches(docs.sparkSession)
    buckets = C.balanced_keys(docs.sparkSession, shuffle_partitions(docs.sparkSession))
    cuts = _splitters(docs, text, len(buckets))
    base, along = C.chunked(docs, text, carry), bool(carry)

    def send_spans(chunk: pa.Table) -> pa.Table:
        gram, context = Chunk(C.in_order(chunk)[1]).pairs
        return C.lists_table(chunk["g"][0].as_py(), buckets, C.spread(gram, len(buckets)), gram, context)

    def judge_spans(bucket: pa.Table) -> pa.Table:
        chunks, starts, (gram, context) = C.joined_lists(bucket, np.uint64)
        order, same = C.repeats((gram, context))
        held = np.zeros(len(order), bool)
        held[order] = same
        # among the first of each pair: does the anchor have another one?
        one = order[~same]
        g = gram[one]
        twin = np.concatenate([[False], g[1:] == g[:-1]])[: len(g)]
        twin |= np.concatenate([twin[1:], [False]])[: len(g)]
        shared = np.zeros(len(order), bool)
        shared[one[twin]] = True
        return C.bits_table(bucket["b"][0].as_py(), chunks, starts, held, shared)

    def decided(work: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of all spans: whether they are repeats, whether their suffixes must be sorted."""
        held, shared = C.read_bits(answers, buckets, C.spread(work.pairs[0], len(buckets)), 2)
        repeat, sort = work.again.copy(), np.zeros(len(work.again), bool)
        repeat[work.first[held]] = True
        sort[work.first[shared]] = True
        return repeat, sort

    def send_suffixes(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        g = chunk["g"][0].as_py()
        work = Chunk(C.in_order(chunk)[1])
        _, lead, rest = work.undecided(decided(work, answers)[1])
        first, _ = _sorted_distinct(lead, rest)
        lead, rest = lead[first], rest[first]
        out = C.lists_table(g, buckets, _ranges(lead, rest, cuts), lead, rest)
        # the answers travel on, spread over the ranges, so that the plan needs them once
        spare = pa.table({"b": pa.array([buckets[(g + i) % len(buckets)] for i in range(len(answers))], pa.int32()), "g": answers["g"], "data": pa.array([np.int32(b).tobytes() + d for b, d in zip(answers["b"].to_pylist(), answers["data"].to_pylist(), strict=True)], pa.binary())})
        kinds = pa.array([1] * len(out) + [0] * len(spare), pa.int32())
        return pa.concat_tables([out, spare]).add_column(0, "kind", kinds)

    def judge_suffixes(bucket: pa.Table) -> pa.Table:
        kind = bucket["kind"].to_numpy()
        lists = bucket.filter(pa.array(kind == 1))
        spare = bucket.filter(pa.array(kind == 0))
        raw = spare["data"].to_pylist()
        out = [pa.table({"b": pa.array([int(np.frombuffer(d, np.int32, 1)[0]) for d in raw], pa.int32()), "g": spare["g"].cast(pa.int32()), "data": pa.array([d[4:] for d in raw], pa.binary())}).add_column(0, "kind", pa.array([0] * len(raw), pa.int32()))]
        if len(lists):
            chunks, starts, keys = C.joined_lists(lists, np.uint64)
            order = multikey_order(*keys)
            same = np.concatenate([[False], (keys[0][order][1:] == keys[0][order][:-1]) & (keys[1][order][1:] == keys[1][order][:-1])])
            held = np.zeros(len(order), bool)
            held[order] = same
            t = C.bits_table(lists["b"][0].as_py(), chunks, starts, held)
            out.append(t.add_column(0, "kind", pa.array([1] * len(t), pa.int32())))
        return pa.concat_tables(out)

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, bodies = C.in_order(chunk)
        work = Chunk(bodies)
        kind = answers["kind"].to_numpy()
        repeat, sort = decided(work, answers.filter(pa.array(kind == 0)))
        at, lead, rest = work.undecided(sort)
        first, again = _sorted_distinct(lead, rest)
        (held,) = C.read_bits(answers.filter(pa.array(kind == 1)), buckets, _ranges(lead[first], rest[first], cuts))
        gone = work.spans_of(repeat)
        if work.total:
            gone |= C.cover(np.sort(at[np.concatenate([again, first[held]])]), LENGTH, work.total)
        del work, at, lead, rest
        ends = np.cumsum([len(b) for b in bodies]).tolist()
        removed, spans, kept = [], [], []
        for b, e in zip(bodies, ends, strict=True):
            mask = gone[e - len(b) : e]
            k = int(mask.sum())
            removed.append(k)
            cut = C.runs(mask).tolist() if k else []
            spans.append([{"begin": x, "end": y} for x, y in cut])
            if whole and k:
                cut = C.runs(whole_characters(b, mask)).tolist()
            kept.append(b"".join(b[x:y] for x, y in zip([0] + [y for _, y in cut], [x for x, _ in cut] + [len(b)], strict=True)) if k else b)
        rest = {"carry": C.carried(chunk)} if along else {}
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(b) for b in bodies], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())} | rest)

    out = StructType.fromDDL(OUT)
    if carry:
        out = out.add("carry", base.schema["carry"].dataType)
    lists = base.groupBy("g").applyInArrow(leanly(send_spans), C.LISTS)
    pairs = C.by_bucket(lists, buckets).applyInArrow(leanly(judge_spans), C.LISTS)
    lists = base.groupBy("g").cogroup(pairs.groupBy("g")).applyInArrow(leanly(send_suffixes), KINDS)
    answers = C.by_bucket(lists, buckets).applyInArrow(leanly(judge_suffixes), KINDS)
    return base.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(leanly(finish), out)


def suffix_deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of the text and n_chars (if there) counted anew.

    Cuts may split a character: what is left of it goes too. Documents of which
    no word is left go; those that had none to begin with stay.
    """
    others = [c for c in docs.columns if c != text]
    # the text itself comes back as kept
    carry = [F.when(F.col(text).isNull(), F.lit(True)).alias("gone"), F.struct(*others).alias("row")]
    out = repeated_suffixes(docs, text, carry, whole=True).where((F.col("n_removed") == 0) | F.decode("kept", "ISO-8859-1").rlike(WORD))
    whole = F.when(F.col("carry.gone"), F.lit(None)).when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(_characters("kept"))
    out = out.select(whole.alias(text), *[F.col("carry.row")[c].alias(c) for c in others])
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _characters(kept: str) -> Column:
    """The text of UTF-8 bytes."""
    return F.make_valid_utf8(F.col(kept).cast("string"))
