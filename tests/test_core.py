"""The edge engine on small documents: golden values of the operators' behaviour."""

import json

import pytest
from pyspark.sql import functions as F

from edgeweave.errors import DecayError, DiffError, GraphError, QueryError, SchemaError, SerializationError, ValidationError
from edgeweave.functions import infer
from edgeweave.functions import lines as L
from edgeweave.functions.values import canonical, number_text, sanitized, unquoted, valid_datetime
from edgeweave.model import STATEMENTS
from edgeweave.operators import conform, decay, diff, graph, protocol, query, repair, stats, validate
from edgeweave.sinks import emit
from edgeweave.sinks import text as sinks
from edgeweave.sources.build import document, edge, from_json, statements_from
from edgeweave.sources.files import parse_files
from edgeweave.sources.parse import is_valid_text, parse_documents
from edgeweave.streaming import reader

SAMPLE = """[Theory_X] -> [Prediction_A] ::mod(confidence=0.95, rule="logical")
[Theory_X] -> [Prediction_B] ::mod(confidence=0.70, rule="causal", strength=0.6)
[Study_Y] -> [Finding_Z] ::mod(confidence=0.85, rule="empirical", source="doi:10.1234/study")
[Events:Start] -> [Events:Running] ::mod(confidence=0.90)
[A] -> [B]
"""


def texts(spark, *items):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "doc_id string, text string")


def parsed(spark, text, **how):
    """A parsed document whose statements are plain rows, so that later plans stay small."""
    doc = parse_documents(texts(spark, text), **how)
    doc.statements = spark.createDataFrame(doc.statements.collect(), STATEMENTS)
    return doc


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def per_item(spark, items, function):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.v for r in rows.select("i", function(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def sample(spark):
    s = parsed(spark, SAMPLE)
    s.statements.cache()
    return s


# --- parsing


def test_parse(sample):
    rows = sample.statements.orderBy("stmt_idx").collect()
    assert [(r.source, r.target) for r in rows][:2] == [("Theory_X", "Prediction_A"), ("Theory_X", "Prediction_B")]
    assert rows[3].source_namespace == "Events" and rows[2].modifiers.source == "doi:10.1234/study"
    assert not rows[4].has_modifiers and rows[4].modifiers is None
    assert sample.documents.first().is_valid


@pytest.mark.parametrize(
    ("text", "n"),
    [("", 0), ("  \n# c\n", 0), ("[A] -> [B] -> [C]", 2), ("[A]\n→\n[B]\n::mod(\n a=1)", 1), ("[A] -> [B] ::mod()", None), ("[A] -> ", None), ("[A.b:C-d] -> [数据]", 1),
     ("[A] -> [B] ::mod(x=1) ::mod(y=2)", None), ("[A] -> [B] # tail", 1), ('[A] -> [B] ::mod(n="x) # [C] -> [D]")', 1), ("[A] -> [B] ::mod(confidence=1.5)", None), ("[A] -> [B] ::mod(version=1.0)", None), ("[NULL] -> [B]", None)],
)
def test_grammar(spark, text, n):
    doc = parsed(spark, text, merge=False)
    assert doc.documents.first().is_valid == (n is not None)
    assert doc.statements.count() == (n or 0)


def test_values(spark):
    s = parsed(spark, '[A] -> [B] ::mod(confidence=95%, strength=1, k=50%, n=7, f=-1.50, t=true, d=2025-10-03, s="a\\"b", k2="x", k2="y", certainty="0.5")').statements.first()
    assert (s.modifiers.confidence, s.modifiers.strength, s.modifiers.certainty) == (0.95, 1.0, 0.5)
    assert s.extra == {"k": "0.5", "n": "7", "f": "-1.50", "t": "true", "d": '"2025-10-03"', "s": '"a\\"b"', "k2": '"y"'}


def test_all_or_nothing(spark):
    doc = parse_documents(texts(spark, "[A] -> [B]\n[C] ->", "[A] -> [B]\n[C] -> [D]"), merge=False)
    assert {r.doc_id for r in doc.statements.collect()} == {"1"}
    assert [(r.doc_id, r.code) for r in doc.diagnostics.collect()] == [("0", "E001")]


def test_extraction(spark):
    md = f"# Title\n\nwords\n```{L.FENCE_TAG}\n[A] -> [B]\n[C] -> [D]\n```\n[E] -> [F]\n"
    doc = parsed(spark, md, mode="auto")
    assert doc.documents.first().format == "fenced" and doc.statements.count() == 2
    mixed = parsed(spark, "Some prose.\nMore of it.\n[A] -> [B] ::mod(confidence=0.9)\nand\n[C] -> [D]\n", mode="auto")
    assert mixed.documents.first().format == "heuristic" and mixed.statements.count() == 2
    broken = parsed(spark, "# Heading\nProse here.\n[A] -> [B]\n[C -> D]\n", mode="auto")
    assert broken.statements.count() == 1 and not broken.documents.first().is_valid
    assert [r.code for r in broken.diagnostics.collect()] == ["E003"]
    assert parsed(spark, "[A] -> [B]\n# note\n", mode="auto").documents.first().format == "pure"


def test_merge(spark):
    got = per_item(spark, ['[A] -> [B] ::mod(\n  rule="t",\n  confidence=0.9\n)', "a\nb", "x(\n# c )\ny)", "open(\nend", "f((\n1)\n)", '[A] -> [B]\n::mod(a="(")'], L.merged_text)
    assert got == ['[A] -> [B] ::mod( rule="t", confidence=0.9 )', "a\nb", "x( y)", "open( end", "f(( 1) )", '[A] -> [B]\n::mod(a="(")']


def test_line_types(spark):
    lines = ["", "# c", "[a](b) -> [c]", "- x", "-> [A] [B]", "> q", "[A] -> [B] ::mod(a=1)", "[A] → [B]", "[A -> B]", "[A] note", "words"]
    assert per_item(spark, lines, L.line_type) == ["empty", "comment", "markdown_link", "markdown_list", "minimal_statement", "markdown_quote", "complete_statement", "minimal_statement", "possible_syntax_error", "not_statement", "natural_language"]


def test_scalars(spark):
    assert per_item(spark, ["a-b", "src/core.py", "黄帝内经", "--", "a__b", "x y"], sanitized) == ["a_b", "src_core_py", "黄帝内经", "Unknown", "a_b", "x_y"]
    numbers = [0.0001, 1e-05, 12345678.0, 1e16, 0.9, -2.5, 100.0, 1.5e-07, 123456789012.25]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, x double")
    assert [r.v for r in rows.select("i", number_text("x").alias("v")).orderBy("i").collect()] == [str(n) for n in numbers]
    assert per_item(spark, ["2025-01-01", "2025-01-01T10:00:00Z", "2025-01-01T10:00:00+02:00", "2025-13-01", "2025-02-30", "2025/01/01", "Past", "2025"], valid_datetime) == [True, True, True, False, False, False, False, False]
    assert per_item(spark, [r"\[Coffee\]", r'"a\[b" \_x'], L.unescaped) == ["[Coffee]", r'"a\[b" _x']
    assert per_item(spark, ["[A] -> [B]", "x"], is_valid_text) == [True, False]


# --- queries


def ids(df):
    return sorted(r.stmt_idx for r in df.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [({"source": "Theory_X"}, [0, 1]), ({"confidence": None}, [4]), ({"confidence__ne": 0.95}, [1, 2, 3, 4]), ({"confidence__gt": 0.0}, [0, 1, 2, 3]), ({"confidence__gte": 0.85, "confidence__lt": 0.95}, [2, 3]),
     ({"source__startswith": "Theory"}, [0, 1]), ({"target__contains": "ing"}, [2, 3]), ({"rule__in": ["causal", "empirical"]}, [1, 2]), ({"rule__ne": "causal"}, [0, 2, 3, 4]), ({"source_namespace": "Events"}, [3]), ({"nothing": None}, [0, 1, 2, 3, 4]), ({"confidence__lte": 0.7, "rule": "causal"}, [1]), ({"arrow": "→"}, [0, 1, 2, 3, 4])],
)
def test_find_all(sample, where, want):
    assert ids(sample.find_all(**where)) == want


def test_query_surface(spark, sample):
    assert ids(sample.find(rule="causal")) == [1] and ids(sample.find(rule="none")) == []
    assert [r.confidence for r in sample.select("confidence").orderBy("stmt_idx").collect()] == [0.95, 0.7, 0.85, 0.9, None]
    assert ids(sample[0]) == [0] and ids(sample[-1]) == [4] and ids(sample[1:3]) == [1, 2] and ids(sample[-2:]) == [3, 4] and ids(sample[::2]) == [0, 2, 4] and ids(sample["A"]) == [4]
    assert sample.pointer("/0/modifiers/confidence").first().value == 0.95
    assert sample.pointer("/3/source/namespace").first().value == "Events" and sample.pointer("/").count() == 5
    for path, code in (("/x", "E451"), ("/-1", "E452"), ("/9", "E452"), ("/0/nope", "E451")):
        with pytest.raises(QueryError) as e:
            sample.pointer(path)
        assert e.value.code == code
    assert query.where_text('confidence__gt=0.8, rule=causal,ok=true,n=3,domain__in=a|b,t="x"') == {"confidence__gt": 0.8, "rule": "causal", "ok": True, "n": 3, "domain__in": ["a", "b"], "t": "x"}
    assert query.run_query(sample.statements, "confidence__gt=0.8", limit=2, count=True).first()["count"] == 2
    with pytest.raises(QueryError):
        query.apply_operator(F.col("x"), "like", 1)
    custom = parsed(spark, '[M] -> [C] ::mod(type="class", line=86, confidence=.9)'.replace("=.9", "=0.9")).statements
    assert ids(query.find_all(custom, line__gt=80, type="class")) == [0] and ids(query.find_all(custom, type__gt=3)) == []
    assert sample.filter(rule="causal").statements.count() == 1


# --- building and writing


def test_build(spark):
    doc = document(spark, edge("[Phys:E]", "M").mod(confidence=1, rule="causal", line=3, ok=True, note="n"), edge("A", "B"))
    assert [r.text for r in doc.to_text().orderBy("stmt_idx").collect()] == ['[Phys:E] -> [M] ::mod(confidence=1.0, line=3, note="n", ok=true, rule="causal")', "[A] -> [B]"]
    for bad in (edge("", "B"), edge("A b", "B"), edge("NULL", "B"), edge("x" * 65, "B"), edge("A", "B").mod(confidence=2), edge("A", "B", source_type="Nope")):
        with pytest.raises(ValidationError):
            bad.build()
    assert edge("A b", "B").no_validate().build()["source"] == "A b"
    with pytest.raises(ValidationError):
        statements_from(spark.range(1), F.lit("a"), F.lit("b"), nope=F.lit(1))


def test_text_roundtrip(spark, sample):
    again = parse_documents(sinks.document_text(sample.statements)).statements.select(*STATEMENTS.names)
    same = lambda s: sorted(r.t for r in s.select(canonical().alias("t")).collect())
    assert same(again) == same(sample.statements)


def test_json(spark, sample):
    rows = from_json(sinks.documents_json(sample.statements))
    same = lambda s: sorted(r.t for r in s.select(canonical().alias("t")).collect())
    assert same(rows) == same(sample.statements)
    assert json.loads(sinks.to_json(sample.statements, ["source", "confidence"], keep_nulls=True).where("stmt_idx = 4").first().json) == {"source": "A", "confidence": None}
    for text, code in (("nope", "E201"), ("[1]", "E200")):
        with pytest.raises(SerializationError) as e:
            from_json(spark.createDataFrame([("0", text)], "doc_id string, json string"))
        assert e.value.code == code


def test_triples(spark):
    s = parsed(spark, '[Theory_Relativity] -> [Prediction_T] ::mod(rule="logical", confidence=0.99, author="Einstein", time="2025-01-20T10:00:00Z")\n[Prediction_T] -> [Experiment_GPS] ::mod(rule="empirical", strength=0.95)').statements
    assert sinks.triples(s).count() == 16
    assert all(r.value.endswith(" .") for r in sinks.ntriples(s).collect()) and sinks.turtle(s).count() == 4
    assert [r.confidence for r in sinks.table(s).collect()] == ["0.99", None]


def test_append_and_read(spark, sample, tmp_path):
    path = str(tmp_path / "log")
    emit.append(sample.statements.limit(3), path, namespace="Log", section="one")
    emit.append(document(spark, edge("A", "B").mod(rule="bad")).statements, path, validate=True)
    back = parse_files(spark, path, "strict")
    got = back.statements.collect()
    assert len(got) == 3 and {r.source_namespace for r in got} == {"Log"} and all(r.modifiers.timestamp for r in got)
    missing = parse_files(spark, str(tmp_path / "none"))
    assert missing.diagnostics.first().code == "E400" and not missing.documents.first().is_valid
    md = tmp_path / "x.md"
    md.write_text("\\[A\\] \\-> \\[B\\]\n")
    assert parse_files(spark, str(md)).statements.count() == 1


# --- decay


def test_decay(spark):
    ref = "2026-02-11 00:00:00"
    doc = document(spark, edge("A", "B").mod(confidence=1.0, timestamp="2026-01-12T00:00:00Z"), edge("A", "B").mod(confidence=0.8, timestamp="2026-02-11T00:00:00Z"), edge("A", "B").mod(confidence=0.5), edge("A", "B").mod(confidence=0.6, timestamp="soon"), edge("A", "B").mod(rule="causal"))
    eff = [r.e for r in doc.statements.select("stmt_idx", decay.effective_confidence(30, ref).alias("e")).orderBy("stmt_idx").collect()]
    assert eff == [0.5, 0.8, 0.5, 0.6, None]
    s = decay.decay_summary(doc.statements, 30, ref).first()
    assert (s.total, s.with_timestamp, s.decayed, s["count"]) == (5, 2, 1, 4)
    assert decay.filter_by_confidence(doc.statements, 0.55, 30, ref).count() == 3
    assert decay.decay_rows(doc.statements, 1, ref).where("stmt_idx = 0").first().effective == 0.0
    with pytest.raises(DecayError):
        decay.effective_confidence(0)


# --- diff and patch


def test_diff(spark):
    a = parsed(spark, '[A] -> [B] ::mod(confidence=0.8, rule="causal")\n[C] -> [D] ::mod(confidence=0.9, rule="logical")\n[E] -> [F] ::mod(confidence=0.7)').statements
    b = parsed(spark, '[A] -> [B] ::mod(confidence=0.95, rule="causal")\n[C] -> [D] ::mod(confidence=0.9, rule="logical")\n[G] -> [H] ::mod(confidence=0.85)').statements
    assert tuple(diff.diff_summary(a, b).first()) == (1, 1, 1, 1, 3, 3)
    by_op = {r.op: r for r in diff.diff(a, b).collect()}
    assert [tuple(c) for c in by_op["modify"].modifier_changes] == [("confidence", "0.8", "0.95")]
    assert {r.line[0] for r in diff.diff_text(diff.diff(a, b)).collect()} == {"+", "-", "~"}
    entries = diff.diff(a, b)
    entries = spark.createDataFrame(entries.collect(), entries.schema)
    back = diff.patch(a, entries, b)
    text = lambda s: [r.t for r in s.select("stmt_idx", canonical().alias("t")).orderBy("stmt_idx").collect()]
    assert text(back) == text(b)
    with pytest.raises(DiffError):
        diff.patch(b, entries, b)
    twice_a, twice_b = (parsed(spark, f"[A] -> [B] ::mod(confidence=0.5)\n[A] -> [B] ::mod(confidence={c})").statements for c in (0.8, 0.9))
    assert tuple(diff.diff_summary(twice_a, twice_b).first())[:4] == (0, 0, 1, 1)
    ns = diff.diff_summary(parsed(spark, "[P:E] -> [M]").statements, parsed(spark, "[Q:E] -> [M]\n[E] -> [M]").statements).first()
    assert (ns.added, ns.removed) == (2, 1)


def test_patch_by_place(spark):
    """Indices with gaps, and with one that an addition shares with an older statement."""
    old = [(i, f"S{i}", "one") for i in range(0, 200_000, 20_000)]
    later = [(i, s, "two" if i % 40_000 else r) for i, s, r in old if i != 60_000] + [(i, f"N{i}", "one") for i in (5, 20_000, 20_001, 100_000, 100_000, 199_999)]
    made = lambda rows: statements_from(spark.createDataFrame(rows, "i int, s string, r string"), F.col("s"), F.lit("T"), doc_id=F.lit("0"), stmt_idx=F.col("i"), rule=F.col("r"))
    a, b = made(old).repartition(3), made(later).repartition(3)
    rows = sorted(diff.patch(a, diff.diff(a, b), b).select("stmt_idx", "source", "modifiers.rule").collect())
    want = sorted(later, key=lambda x: (x[0], x[1][0] == "N"))
    assert [tuple(r) for r in rows] == [(at, s, r) for at, (_, s, r) in enumerate(want)]


# --- graph


def test_graph(spark):
    line = parsed(spark, "[A] -> [B]\n[B] -> [C]\n[C] -> [D]").statements
    assert tuple(graph.summary(line).first()) == (4, 3)
    assert [r.path for r in graph.simple_paths(line, "[A]", "[D]").collect()] == [["[A]", "[B]", "[C]", "[D]"]]
    assert graph.cycles(line).count() == 0 and graph.degree(line, "[B]") == 2
    with pytest.raises(GraphError):
        graph.simple_paths(line, "[A]", "[Z]")
    with pytest.raises(GraphError):
        graph.degree(line, "[Z]")
    ring = parsed(spark, "[A] -> [B]\n[B] -> [C]\n[C] -> [A]\n[C] -> [C]\n[A] -> [B]").statements
    assert sorted(r.cycle for r in graph.cycles(ring).collect()) == [["[A]", "[B]", "[C]"], ["[C]"]]
    assert graph.degree(ring, "[C]") == 4 and graph.simple_paths(ring, "[A]", "[C]").count() == 2
    apple = parsed(spark, '[Apple] -> [Red] ::mod(relation="has_color", confidence=0.9)\n[Apple] -> [Green] ::mod(relation="has_color", confidence=0.8)\n[Apple] -> [Fruit] ::mod(relation="is_a")').statements
    c = graph.conflicts(apple).collect()
    assert len(c) == 1 and c[0].targets == ["Red", "Green"] and abs(c[0].tension_score - 1.7) < 1e-9
    m = graph.tension_metrics(parsed(spark, '[Sky] -> [Blue] ::mod(relation="has_color")\n[Sky] -> [Green] ::mod(relation="has_color", confidence=0.5)').statements).first()
    assert tuple(m) == (1, 1.5, 1.5) and tuple(graph.tension_metrics(line).first()) == (0, 0.0, 0.0)
    assert graph.top_central(line).first().node == "[B]" and graph.nodes(line).count() == 4
    assert graph.subgraph(parsed(spark, '[A] -> [B] ::mod(domain="x")\n[A] -> [C]').statements, "x").count() == 1


# --- statistics and validation


def test_stats(spark, sample):
    s = sample.statements
    c = stats.counts(s).first()
    assert (c.total_statements, c.unique_statements, c.unique_anchors) == (5, 5, 9)
    assert {r.path_type: r["count"] for r in stats.path_types(s).collect()} == {"Inferential": 2, "Causal": 1, "UNKNOWN": 2}
    u = {r.key: r for r in stats.modifier_usage(s).collect()}
    assert u["confidence"].frequency == 4 and u["confidence"].max == 0.95 and u["rule"].min is None
    assert stats.missing_provenance(s).count() == 2 and stats.confidence_metrics(s).count() == 1
    twice = parsed(spark, "[A] -> [B]\n[A] -> [B] ::mod(confidence=0.9)\n[B] -> [A]").statements
    assert ids(stats.duplicates(twice)) == [1]
    assert set(stats.report(twice)) >= {"counts", "cycles", "graph"}
    names = ["Event_X", "Einstein", "A", "PhotonDecay", "Question_1", "my_agent", "test_it", "word"]
    assert per_item(spark, names, infer.analysis_type) == ["Event", "Name", "Name", "Concept", "Question", "Agent", "Verifier", "Concept"]
    assert per_item(spark, ["UserX", "action1", "question", "link_a", "Albert", "thing"], infer.anchor_type) == ["Agent", "Event", "Question", "Relational", "Name", "Concept"]


def test_validation(spark):
    s = parsed(spark, '[A1] -> [Bb] ::mod(rule="guess", time="Past", necessity="Maybe", conditionality="None", confidence=0.2)\n[Aa] -> [Bb] ::mod(rule="empirical", necessity="Necessary")\n[Aa] -> [B123]\n[Aa] -> [Bb]')
    got = sorted((r.statement_index, r.code) for r in validate.diagnostics(s.statements).collect())
    assert got == sorted([(0, "E107"), (0, "E112"), (0, "E105"), (0, "E105"), (0, "W003"), (1, "E111"), (2, "W004"), (2, "W002"), (3, "W004"), (3, "W006")])
    causal = document(spark, edge("Aa", "Bb", path_type="Causal").mod(strength=0.0), edge("Ab", "Bb", path_type="Causal").mod(cause="x"))
    assert [(r.statement_index, r.code) for r in validate.diagnostics(causal.statements).collect()] == [(0, "E113")]
    fine = parsed(spark, '[Aa] -> [Bb] ::mod(rule="causal", confidence=0.4)')
    assert validate.validate(fine).documents.first().is_valid and not validate.validate(fine, strict=True).documents.first().is_valid


def test_schema(spark):
    text = """schema EventLog v1.0 { # c
      namespace "Events"
      anchor source { namespace: required("Events") pattern: /[A-Z]\\w+/ }
      anchor target { namespace: optional }
      modifier { required: [confidence, rule] optional: [source_file]
        confidence: float(0.5, 1.0) rule: enum("causal", "logical") source_file: string }
      constraints { max_statements: 2 allow_cycles: false } }"""
    s = conform.parse_schema(text)
    assert (s.name, s.version, s.namespace, s.required, s.fields["rule"].values) == ("EventLog", "1.0", "Events", ["confidence", "rule"], ["causal", "logical"])
    rows = parsed(spark, '[Events:Go] -> [X] ::mod(confidence=0.9, rule="causal")\n[go] -> [X] ::mod(confidence=0.1, rule="other")\n[Events:Go] -> [X]').statements
    got = sorted((r.statement_index if r.statement_index is not None else -1, r.code, r.field) for r in conform.conformance(rows, s).collect())
    assert got == [(-1, "E601", "statements"), (1, "E601", "source"), (1, "E601", "source"), (1, "E603", "confidence"), (1, "E603", "rule"), (2, "E601", "confidence"), (2, "E601", "rule")]
    again = conform.from_struct("EventLog", conform.to_struct(s))
    assert again.fields == s.fields and again.required == s.required
    assert "confidence" in conform.prompt(s)
    with pytest.raises(SchemaError):
        conform.parse_schema("schema X { modifier { a float } }")


# --- repair


def test_repair(spark):
    lines = ["A -> [B]", "[A] -> B", "[A] -> [B] mod(confidence=0.9)", "[A] -> [B] ::mod(rule=causal)", "[A] -> [B] ::mod(confidence=1.5)", "[A] -> [B] ::mod(strength=-0.5)", "[A] -> [B] ::mod(confience=0.9)", "# mod(x", '[A] -> [B] ::mod(a=b c, q="x, y)", n=3, t=True)', "X -> Y mod(rule=causal, confidence=2)"]
    want = ["[A] -> [B]", "[A] -> [B]", "[A] -> [B] ::mod(confidence=0.9)", '[A] -> [B] ::mod(rule="causal")', "[A] -> [B] ::mod(confidence=1.0)", "[A] -> [B] ::mod(strength=0.0)", "[A] -> [B] ::mod(confidence=0.9)", "# mod(x", '[A] -> [B] ::mod(a="b c", q="x, y)", n=3, t=True)', '[X] -> [Y] ::mod(rule="causal", confidence=1.0)']
    assert per_item(spark, lines, L.repaired) == want
    fixed = repair.repair(texts(spark, "\n".join(lines))).first()
    assert fixed.text == "\n".join(want)
    assert {r.type for r in fixed.repairs} == {"fix_mod_prefix", "add_brackets", "quote_string", "clamp_value", "fix_typo"}
    doc, cleaned, _ = repair.validate_output(texts(spark, "Sure:\n```\n[A] => [B] mod(\n rule=causal)\n```\nA => B mod(confience=1.5)"))
    assert [(r.source, r.modifiers.rule) for r in doc.statements.collect()] == [("A", "causal")] and doc.documents.first().is_valid


# --- streaming


def test_lines(spark):
    text = "# header\n\n[A] -> [B] ::mod(\n confidence=0.9,\n rule=\"x\"\n)\n[C] -> [D] -> [E]\n[bad -> \n"
    t = texts(spark, text)
    got = sorted((r.line, r.source) for r in reader.line_statements(t, "skip").collect())
    assert got == [(3, "A"), (7, "C")]
    assert sorted((r.line, r.code) for r in reader.line_errors(t).collect()) == [(8, "E001")]
    s = reader.stats(t).first()
    assert (s.statements_yielded, s.errors_skipped, s.comments_seen) == (2, 1, 1)
    assert reader.line_statements(t, "skip", confidence__gt=0.5).count() == 1
    with pytest.raises(Exception, match="E001"):
        reader.line_statements(t, "raise").collect()
    long = texts(spark, "[A] -> [B] ::mod(\n" + "\n".join(f"k{i}={i}," for i in range(24)) + "\nz=1)")
    assert [r.code for r in reader.line_errors(long).collect()] == ["E962"]


def test_streams(spark, tmp_path):
    source, log = tmp_path / "in", tmp_path / "log.txt"
    source.mkdir()
    (source / "a.txt").write_text("[A] -> [B] ::mod(confidence=0.9)\n[C] -> [D]\n")
    q = reader.read_stream(spark, str(source), confidence__gt=0.5).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 1
    log.write_text("[A] -> [B]\n[C] -> [D]\n[half")
    q = reader.tail(spark, str(log)).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        q.processAllAvailable()
        assert spark.table("tailed").count() == 2
        with log.open("a") as f:
            f.write("way] -> [E]\n")
        q.processAllAvailable()
        assert sorted(r.source for r in spark.table("tailed").collect()) == ["A", "C", "halfway"]
    finally:
        q.stop()


# --- protocol


def test_protocol(spark):
    s = parsed(spark, '[A] -> [B] ::mod(role="x")\n[A] -> [A] ::mod(action="intrinsic_properties", size=3)\n[A] -> [C] ::mod(role="x", timestamp="2025-01-01")').statements
    d = protocol.defaults(s).orderBy("stmt_idx").collect()
    assert (d[0].modifiers.rule, d[0].modifiers.confidence) == ("definitional", 1.0)
    assert [r.attributes for r in protocol.node_attributes(s).collect()] == [{"size": "3"}]
    assert [(r.target, r.superseded_by) for r in protocol.superseded(s).where("meta_field = 'role'").collect()] == [("B", "[C]")]
    assert value(spark, unquoted(F.lit('"x"'))) == "x"


def test_entry_and_catalog(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
