"""The pipeline against a plain Python version of all its stages, and the registered queries on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import texts
from tests.llm.test_operators import WORD, brute_counts, brute_print, library

SMALL = "/root/testdata/sf0.001"


def plain(docs):
    """[(doc_id, text, source)] of the mix, from those of the table."""
    kept = []
    for d, t, s in docs:
        n, *_, repeated = brute_counts(t)
        if n >= 10 and 100 * repeated <= 20 * n:
            kept.append((d, t, s))
    prints = [brute_print(t) for _, t, _ in kept]
    root = list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(kept):
        least[find(i)] = min(d, least.get(find(i), d))
    kept = [x for i, x in enumerate(kept) if x[0] == least[find(i)]]
    seen, cut = set(), []
    for d, t, s in sorted(kept):
        body = t.encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 99):
            w = body[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        text = re.sub("�+", "", left.decode("utf-8", "replace")) if any(gone) else t
        if not any(gone) or WORD.search(text):
            cut.append((d, text, s))
    size = {d: len(WORD.findall(t)) for d, t, _ in cut}
    totals = Counter()
    for d, _, s in cut:
        totals[s] += size[d]
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(totals.values()), set(names)
    while open_:
        shares = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 2 * totals[s]}
        target |= shares if not over else {s: 2.0 * totals[s] for s in over}
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    out = []
    for name in names:
        mine = sorted((x for x in cut if x[2] == name), key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest())
        whole = math.floor(target[name] + 1e-9)
        passes, rest, at = whole // totals[name], whole % totals[name], 0
        for d, t, _ in mine:
            more = max(0, min(size[d], rest - at))
            at += size[d]
            out += [(d, t)] * (passes + (more > 0 and 2 * more >= size[d]))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, ["en", "de"][i % 2], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(rows), 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_run(spark, folder):
    path, rows = folder
    out = corpus_pipeline.run(spark, path).collect()
    whole = library()
    want = Counter()
    for d, t in plain([(r[0], r[1], r[3]) for r in rows]):
        ids = np.array(whole(t), "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, x, y - x, zlib.crc32(ids[x:y].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_return_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_queries_against_sql(spark):
    import duckdb

    from edgeweave.llm.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in ORACLES.items():
        rel = con.sql(sql)
        cols = sorted(rel.columns)
        want = Counter(tuple(dict(zip(rel.columns, r, strict=True))[c] for c in cols) for r in rel.fetchall())
        got = Counter(tuple(r[c] for c in cols) for r in QUERIES[name](spark, SMALL).collect())
        assert got == want, name
