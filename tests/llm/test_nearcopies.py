"""Near copies by shingle similarity against a brute-force version."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from edgeweave.llm import nearcopies
from tests.llm.conftest import texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows):
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(rows))]


def cases():
    """Texts, copies at similarities on both sides of 0.8, and a chain of them."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    out = list(texts())
    for k in range(40):
        base = [r.choice(words) for _ in range(150)]
        out.append(" ".join(base))
        for _ in range(2):
            w = list(base)
            for at in r.sample(range(150), k % 5 + 1):
                w[at] = r.choice(words)
            out.append(" ".join(w))
    w = [r.choice(words) for _ in range(200)]
    for _ in range(12):
        w = [*w[6:], *[r.choice(words) for _ in range(6)]]
        out.append(" ".join(w))
    return list(enumerate(out))


def test_near_copies(spark):
    rows = cases()
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(3)
    want = brute_components(rows)
    assert Counter((r.doc_id, r.component_id) for r in nearcopies.near_copies(docs).collect()) == Counter((d, c) for (d, _), c in zip(rows, want, strict=True))
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for (d, _), c in zip(rows, want, strict=True) if d == c]
    assert nearcopies.near_copies(docs.where("false")).count() == 0


def test_survivor_by_row(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    c = " ".join(f"c{i}" for i in range(30))
    rows = [(5, a), (5, b), (3, b), (7, a), (None, a), (None, c), (None, c), (9, "alone here"), (9, "alone here")]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA)
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, a), (3, b), (None, c), (9, "alone here")])


def test_group_around_a_common_text(spark):
    """Many edits of one text, most of them too far from each other; some share a second edit, some are close to one another only."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, out = [word() for _ in range(100)], []
    second = [*base[:40], *[word() for _ in range(12)], *base[52:]]
    for k in range(260):
        w = list(second if k % 3 == 0 else base)
        for at in r.sample(range(100), r.choice([1, 2, 4, 6, 8])):
            w[at] = word()
        out.append(" ".join(w))
        if k % 20 == 0:
            w[50] = word()
            out.append(" ".join(w))
    rows = list(enumerate(out))
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(3)
    want = brute_components(rows)
    assert len(set(want)) > 20
    assert Counter((x.doc_id, x.component_id) for x in nearcopies.near_copies(docs).collect()) == Counter((d, c) for (d, _), c in zip(rows, want, strict=True))


def test_blocks_of_fingerprints():
    """Sets at a similarity of exactly 0.8 share a block of their SimHash fingerprints and few of the further bits differ; others differ in half."""
    r = np.random.default_rng(5)
    for documents in (1000, 1 << 20):
        blocks, width = nearcopies.shape(documents)
        for n in (4, 40, 400):
            both = [r.integers(0, 1 << 64, 2 * n, np.uint64) for _ in range(150)]
            own = lambda: [np.concatenate([x, r.integers(0, 1 << 64, n // 4, np.uint64)]) for x in both]  # noqa: E731, B023
            (ka, ba), (kb, bb) = (nearcopies.fingerprints(x, blocks, width) for x in (own(), own()))
            assert (ka == kb).any(axis=1).all()
            differ = np.bitwise_count((ba ^ bb).view(np.uint64)).sum(axis=1)
            assert differ.max() <= nearcopies.MOST and abs(differ.mean() / nearcopies.BITS - nearcopies.APART) < 0.02
            assert abs(np.bitwise_count((ba ^ np.roll(bb, 1, axis=0)).view(np.uint64)).sum(axis=1).mean() / nearcopies.BITS - 0.5) < 0.02


def test_meetings(spark, monkeypatch):
    """Members of a key stay if another one may link, also where a key is spread over batches; of a large key all stay."""
    r = np.random.default_rng(6)
    bits = r.integers(-(1 << 63), (1 << 63) - 1, (3000, 2), np.int64)
    bits[::7] = bits[1::7][: len(bits[::7])] ^ 5
    rows = [(i, [int(r.integers(0, 40)), 0 if i % 2 else i], int(x), int(y)) for i, (x, y) in enumerate(bits)]
    size = Counter((c, k) for _, keys, *_ in rows for c, k in enumerate(keys))
    near = np.bitwise_count((bits[:, None] ^ bits[None]).view(np.uint64)).sum(axis=2) <= nearcopies.MOST_FIRST
    want = set()
    for i, keys, *_ in rows:
        for c, k in enumerate(keys):
            if size[c, k] > 1000 or any(rows[j][1][c] == k for j in np.flatnonzero(near[i]).tolist() if j != i):
                want.add((c, k, i))
    monkeypatch.setattr(nearcopies, "LONG", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = nearcopies.meetings(spark.createDataFrame(rows, "node long, keys array<int>, b0 long, b1 long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(tuple(x) for x in got) == Counter(want) and 1500 < len(want) < 3500


def test_rows_for_the_second_round(spark, monkeypatch):
    """Small groups give no row for a shingle, larger ones only for those ahead in the prefix filter; the components stay the same."""
    made = Counter()
    real = nearcopies.materialise

    def counted(df, label="t", keep=False):
        out = real(df, label, keep)
        made[label] += out.count()
        return out

    rows = cases()
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(3)
    want = Counter(zip((d for d, _ in rows), brute_components(rows), strict=True))
    monkeypatch.setattr(nearcopies, "materialise", counted)
    assert Counter((x.doc_id, x.component_id) for x in nearcopies.near_copies(docs).collect()) == want
    assert made["open-nodes"] > 20 and made["sets"] == made["beside"] == 0
    made.clear()
    monkeypatch.setattr(nearcopies, "SMALL", 1)  # all are large groups: a fifth of the shingles and one more are ahead
    assert Counter((x.doc_id, x.component_id) for x in nearcopies.near_copies(docs).collect()) == want
    longest = max(len(brute_set(t)) for _, t in rows)
    assert made["sets"] > 20 and 0 < made["beside"] <= made["sets"] * (longest // 5 + 1)


def test_parts_of_a_key():
    """Members of a key that differ in few bits share a part, also over others; each slot is for itself."""
    r = np.random.default_rng(7)
    bits = lambda n: r.integers(-(1 << 63), (1 << 63) - 1, (n, 2), np.int64)
    chain = np.repeat(bits(1), 4, axis=0)
    for k in range(1, 4):
        chain[k:, 0] ^= np.int64(((1 << 21) - 1) << (21 * (k - 1)))
        chain[k:, 1] ^= np.int64(((1 << 20) - 1) << (20 * (k - 1)))
    slot, rows = [], []
    for s in range(30):
        one = np.concatenate([chain, np.repeat(bits(1), 3, axis=0), bits(5), np.repeat(bits(1), 2, axis=0)])
        slot += [s] * len(one)
        rows.append((one, r.permutation(len(one))))
    got = nearcopies.parts(np.array(slot), *np.concatenate([one[at] for one, at in rows]).T.copy())
    want = np.array([0] * 4 + [1] * 3 + [-1] * 5 + [2] * 2)
    for s, (one, at) in enumerate(rows):
        mine, own = got[s * len(one) : (s + 1) * len(one)], want[at]
        assert ((mine < 0) == (own < 0)).all()
        assert all((mine[i] == mine[j]) == (own[i] == own[j]) for i in range(len(one)) for j in range(len(one)) if own[i] >= 0)
        assert set(mine[mine >= 0] // len(one)) == {s}


def test_rows_of_open_keys(spark, monkeypatch):
    """Keys whose members lie in groups of their own, or share them by chance, give no row for the second round; few pairs are checked."""
    made, pairs = Counter(), []
    real, check = nearcopies.materialise, nearcopies.verified

    def counted(df, label="t", keep=False):
        out = real(df, label, keep)
        made[label] += out.count()
        return out

    def checked(asked, texts):
        asked = real(asked, "asked")
        pairs.append(asked.count())
        return check(asked, texts)

    rows = cases()
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(nearcopies, "materialise", counted)
    monkeypatch.setattr(nearcopies, "verified", checked)
    got = Counter((x.doc_id, x.component_id) for x in nearcopies.near_copies(docs).collect())
    assert got == Counter(zip((d for d, _ in rows), brute_components(rows), strict=True))
    assert made["meetings"] > 1000 and 20 * made["keyed"] < made["meetings"]
    assert sum(pairs) < 2 * made["open-nodes"]


def test_common_sets(spark):
    """What nearly all of a group have is its common set, what few have is not, however the group is dealt out."""
    sets = [(g, 300, [1, 2 if i % 10 else -i - 1000, 3 if i < 60 else -i, *range(1000 * i + 10, 1000 * i + 40)]) for g in (7, 8) for i in range(300)]
    df = spark.createDataFrame([(g, m, sorted(own)) for g, m, own in sets], "hub long, members long, own array<long>")
    for n in (1, 7, 60):
        assert {r.c_hub: sorted(r.common) for r in nearcopies.common_sets(df.repartition(n)).collect()} == {7: [1, 2], 8: [1, 2]}
    assert nearcopies.common_sets(df.where("false")).count() == 0
