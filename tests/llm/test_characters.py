import numpy as np

from edgeweave.llm import suffixes


def test_replacement_characters_stay(spark):
    passage = " ".join(f"passage{i}" for i in range(20))
    rows = [(1, f"one \u00e9{passage}"), (2, f"word \ufffd \u0129{passage} \ufffd end")]
    out = suffixes.suffix_deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "word \ufffd  \ufffd end"}


def test_whole_characters():
    body = "a\u00e9\u6570b".encode() + b"\x80\x80c"
    for at, want in [(0, [0]), (2, [1, 2]), (3, [3, 4, 5]), (5, [3, 4, 5]), (7, [7]), (8, [8])]:
        mask = np.zeros(len(body), bool)
        mask[at] = True
        assert np.flatnonzero(suffixes.whole_characters(body, mask)).tolist() == want
