"""Registered queries of the edge engine, each with its SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import lines as L
from ..functions.values import canonical, number_text, sanitized, valid_datetime, valid_name
from ..operators import conform, decay, diff, graph, protocol, query, repair, stats, validate
from ..sinks import text as sinks
from ..sources.build import from_json
from ..sources.parse import is_valid_text, parse_documents
from ..streaming import reader
from . import lift

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
REFERENCE = "2001-08-01 00:00:00"

_RULE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'causal' WHEN '2-HIGH' THEN 'logical' WHEN '3-MEDIUM' THEN 'empirical' WHEN '4-NOT SPECIFIED' THEN 'definitional' ELSE 'correlative' END"
_O = f"o AS (SELECT 'C_' || o_custkey AS source, 'O_' || o_orderkey AS target, o_orderkey AS k, {_RULE} AS rule, least(o_totalprice / 500000, 1.0) AS confidence, o_orderdate AS ts, o_orderstatus AS domain, o_orderpriority AS pc FROM orders)"
_SAN = "CASE WHEN {0} = '' THEN 'Unknown' ELSE {0} END"
_san = lambda x: _SAN.format(f"trim(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_')")
_P = f"p AS (SELECT 'P_' || p_partkey AS source, {_san('p_brand')} AS target, 0 AS i, 0.9 AS confidence, p_partkey FROM part UNION ALL SELECT 'P_' || p_partkey, {_san('p_type')}, 1, 0.6, p_partkey FROM part)"
_AGE = f"(epoch(TIMESTAMP '{REFERENCE}') - epoch(date_trunc('second', ts))) / 86400.0"
_EFF = f"CASE WHEN {_AGE} > 0 THEN least(1.0, greatest(0.0, confidence * pow(0.5, {_AGE} / 365.0))) ELSE confidence END"


def registered(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["decay_filter"](spark, sf_dir)


def _short(df: DataFrame) -> DataFrame:
    return df.select("source", "target", "stmt_idx")


_FIND = {
    "find_eq": ({"rule": "causal"}, "rule = 'causal'"),
    "find_ne": ({"rule__ne": "causal"}, "rule <> 'causal'"),
    "find_null": ({"necessity": None, "domain": "F"}, "domain = 'F'"),
    "find_range": ({"confidence__gte": 0.25, "confidence__lt": 0.5}, "confidence >= 0.25 AND confidence < 0.5"),
    "find_contains": ({"target__contains": "77"}, "contains(target, '77')"),
    "find_startswith": ({"source__startswith": "C_1"}, "starts_with(source, 'C_1')"),
    "find_in": ({"rule__in": ["causal", "empirical"]}, "rule IN ('causal', 'empirical')"),
    "find_extra": ({"priority_class": "2-HIGH", "confidence__gt": 0.9}, "pc = '2-HIGH' AND confidence > 0.9"),
}
for _name, (_where, _sql) in _FIND.items():
    registered(_name, f"WITH {_O} SELECT source, target, k::INTEGER AS stmt_idx FROM o WHERE {_sql}")(lambda s, d, w=_where: _short(query.find_all(lift.orders(s, d), **w)))


@registered("find_first", f"WITH {_O} SELECT source, target, k::INTEGER AS stmt_idx FROM o WHERE rule = 'logical' AND confidence > 0.5 ORDER BY k LIMIT 1")
def find_first(s, d):
    return _short(query.find(lift.orders(s, d), rule="logical", confidence__gt=0.5))


@registered("where_text", f"WITH {_O} SELECT source, target, k::INTEGER AS stmt_idx FROM o WHERE confidence > 0.8 AND domain IN ('F', 'P')")
def where_text(s, d):
    return _short(query.find_all(lift.orders(s, d), **query.where_text("confidence__gt=0.8,domain__in=F|P")))


@registered("select_fields", f"WITH {_O} SELECT source, rule, round(confidence, 9) AS confidence, pc AS priority_class, NULL::VARCHAR AS necessity FROM o")
def select_fields(s, d):
    out = query.select(lift.orders(s, d), "source", "rule", "confidence", "priority_class", "necessity")
    return out.select("source", "rule", F.round("confidence", 9).alias("confidence"), "priority_class", "necessity")


@registered("pointer_value", f"WITH {_P} SELECT p_partkey::VARCHAR AS doc_id, confidence::DOUBLE AS value FROM p WHERE i = 1")
def pointer_value(s, d):
    return query.pointer(lift.parts(s, d), "/1/modifiers/confidence").select("doc_id", "value")


@registered("index_last", f"WITH {_P} SELECT source, target FROM p WHERE i = 1")
def index_last(s, d):
    return query.item(lift.parts(s, d), -1).select("source", "target")


@registered("index_slice", "SELECT 'O_' || l_orderkey AS source, 'P_' || l_partkey AS target FROM lineitem WHERE l_linenumber - 1 >= 1 AND l_linenumber - 1 < 5 AND (l_linenumber - 2) % 2 = 0")
def index_slice(s, d):
    return query.item(lift.lineitem(s, d), slice(1, 5, 2)).select("source", "target")


@registered("item_by_source", f"WITH {_O} SELECT source, target, k::INTEGER AS stmt_idx FROM o WHERE source = 'C_7'")
def item_by_source(s, d):
    return _short(query.item(lift.orders(s, d), "C_7"))


@registered("query_count", f"WITH {_O} SELECT count(*) AS count FROM o WHERE rule = 'causal' AND confidence > 0.2")
def query_count(s, d):
    return query.run_query(lift.orders(s, d), "rule=causal,confidence__gt=0.2", count=True)


@registered("query_limit", f"WITH {_O} SELECT source, target FROM o WHERE rule = 'causal' ORDER BY k LIMIT 25")
def query_limit(s, d):
    return query.run_query(lift.orders(s, d), "rule=causal", "source,target", limit=25).select("source", "target")


@registered("canonical_text", f"""WITH {_P} SELECT '[' || source || '] -> [' || target || '] ::mod(confidence=' || confidence::DOUBLE || ', relation="is_a")' AS text FROM p""")
def canonical_text(s, d):
    return sinks.canonical_text(lift.parts(s, d)).select("text")


@registered("number_text", "SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT)::VARCHAR || '.0' AS a, '1e-05' AS b FROM lineitem")
def number_as_text(s, d):
    return lift.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", number_text("l_quantity").alias("a"), number_text(F.col("l_quantity") * 0 + 0.00001).alias("b"))


def _texts(s, d) -> DataFrame:
    return sinks.document_text(lift.parts(s, d))


@registered("parse_roundtrip", f"WITH {_P} SELECT p_partkey::VARCHAR AS doc_id, i AS stmt_idx, source, target, confidence::DOUBLE AS confidence, 'is_a' AS relation FROM p")
def parse_roundtrip(s, d):
    rows = parse_documents(_texts(s, d)).statements
    return rows.select("doc_id", "stmt_idx", "source", "target", F.col("modifiers.confidence").alias("confidence"), query.field("relation").alias("relation"))


@registered("parse_all_or_nothing", f"WITH {_P} SELECT p_partkey::VARCHAR AS doc_id, p_partkey % 3 <> 0 AS is_valid, CASE WHEN p_partkey % 3 <> 0 THEN 2 ELSE 0 END::BIGINT AS n FROM part")
def parse_all_or_nothing(s, d):
    t = _texts(s, d).withColumn("text", F.when(F.col("doc_id").cast("long") % 3 == 0, F.concat("text", F.lit("\n[A] -> "))).otherwise(F.col("text")))
    doc = parse_documents(t)
    n = doc.statements.groupBy("doc_id").agg(F.count("*").alias("n"))
    return doc.documents.join(n, "doc_id", "left").select("doc_id", "is_valid", F.coalesce("n", F.lit(0)).alias("n"))


@registered("parse_diagnostics", "SELECT p_partkey::VARCHAR AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'E001' ELSE 'E002' END AS code FROM part WHERE p_partkey % 4 < 2")
def parse_diagnostics(s, d):
    k = F.col("doc_id").cast("long") % 4
    extra = F.when(k == 0, "\n[A] => [B]").when(k == 1, "\n[A] -> [B] ::mod(confidence=1.5)").otherwise("\n# fine")
    return parse_documents(_texts(s, d).withColumn("text", F.concat("text", extra))).diagnostics.select("doc_id", "code")


@registered("chain_expand", "SELECT 'C_' || c_custkey AS doc_id, 0 AS stmt_idx, 'C_' || c_custkey AS source, 'N_' || c_nationkey AS target, NULL AS rule FROM customer UNION ALL SELECT 'C_' || c_custkey, 1, 'N_' || c_nationkey, 'R_' || n_regionkey, 'definitional' FROM customer JOIN nation ON c_nationkey = n_nationkey")
def chain_expand(s, d):
    c = lift.table(s, d, "customer").join(lift.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.format_string('[C_%d] -> [N_%d] → [R_%d] ::mod(rule="definitional")', "c_custkey", "c_nationkey", "n_regionkey")
    out = parse_documents(c.select(F.concat(F.lit("C_"), "c_custkey").alias("doc_id"), text.alias("text"))).statements
    return out.select("doc_id", "stmt_idx", "source", "target", F.col("modifiers.rule").alias("rule"))


@registered("last_key_wins", "SELECT c_custkey::VARCHAR AS doc_id, 0.5::DOUBLE AS confidence, c_custkey::VARCHAR AS n FROM customer")
def last_key_wins(s, d):
    text = F.format_string("[A] -> [B] ::mod(confidence=0.9, n=0, confidence=50%%, n=%d)", "c_custkey")
    out = parse_documents(lift.table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))).statements
    return out.select("doc_id", F.col("modifiers.confidence").alias("confidence"), query.field("n").alias("n"))


@registered("valid_text", "SELECT c_custkey, c_custkey % 4 < 2 AS ok FROM customer")
def valid_text(s, d):
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, '[A] -> [数据:乙] ::mod(note="a -> [b]) # c") # end').when(k == 1, "# only a comment\n").when(k == 2, "[A] -> [B] ::mod()").otherwise("[A] [B]")
    return lift.table(s, d, "customer").select("c_custkey", F.coalesce(is_valid_text(text.cast("string")), F.lit(False)).alias("ok"))


def _kinds(s, d) -> DataFrame:
    o = lift.table(s, d, "orders")
    k = F.col("o_orderkey") % 9
    a = F.format_string("[C_%d] -> [O_%d]", "o_custkey", "o_orderkey")
    line = (
        F.when(k == 0, F.concat(a, F.lit(" ::mod(confidence=0.5)"))).when(k == 1, a).when(k == 2, F.concat(F.lit("# "), a)).when(k == 3, F.concat(F.lit("- "), a)).when(k == 4, F.concat(F.lit("> "), a))
        .when(k == 5, "[A -> B").when(k == 6, "plain words").when(k == 7, "[link](http://x) -> [B]").otherwise("   ")
    )
    return o.select("o_orderkey", line.alias("line"))


@registered("line_classify", "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'complete_statement' WHEN 1 THEN 'minimal_statement' WHEN 2 THEN 'comment' WHEN 3 THEN 'markdown_list' WHEN 4 THEN 'markdown_quote' WHEN 5 THEN 'not_statement' WHEN 6 THEN 'natural_language' WHEN 7 THEN 'markdown_link' ELSE 'empty' END AS kind FROM orders")
def line_classify(s, d):
    return _kinds(s, d).select("o_orderkey", L.line_type("line").alias("kind"))


@registered("merge_multiline", "SELECT p_partkey::VARCHAR AS doc_id, '[A] -> [B] ::mod( confidence=0.5, n=' || p_partkey || ' )' AS text FROM part")
def merge_multiline(s, d):
    text = F.format_string("[A] -> [B] ::mod(\n  # a ) comment\n  confidence=0.5,\n  n=%d\n)", "p_partkey")
    return lift.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), L.merged_text(text).alias("text"))


@registered("fence_extract", f"WITH {_P} SELECT p_partkey::VARCHAR AS doc_id, source, target, 'fenced' AS format FROM p")
def fence_extract(s, d):
    t = _texts(s, d).withColumn("text", F.concat(F.lit(f"# Notes\nwords [x] -> [y]\n```{L.FENCE_TAG}\n"), "text", F.lit("\n```\nmore words")))
    doc = parse_documents(t, "auto")
    return doc.statements.join(doc.documents, "doc_id").select("doc_id", "source", "target", "format")


@registered("heuristic_extract", f"WITH {_P} SELECT p_partkey::VARCHAR AS doc_id, source, target, 'heuristic' AS format FROM p")
def heuristic_extract(s, d):
    t = _texts(s, d).withColumn("text", F.concat(F.lit("Some words first.\nThen more words.\n- a list\n"), "text", F.lit("\nand an end.")))
    doc = parse_documents(t, "auto")
    return doc.statements.join(doc.documents, "doc_id").select("doc_id", "source", "target", "format")


@registered("unescape", "SELECT p_partkey, '[P_' || p_partkey || '] -> [B] ::mod(note=\"a\\[b\")' AS text FROM part")
def unescape(s, d):
    text = F.format_string('\\[P\\_%d\\] \\-\\> \\[B\\] ::mod(note="a\\[b")', "p_partkey")
    return lift.table(s, d, "part").select("p_partkey", L.unescaped(text).alias("text"))


@registered("sanitize_anchor", f"SELECT p_partkey, {_san('p_name')} AS name, {_san('p_brand')} AS brand, 'Unknown' AS none FROM part")
def sanitize_anchor(s, d):
    return lift.table(s, d, "part").select("p_partkey", sanitized("p_name").alias("name"), sanitized("p_brand").alias("brand"), sanitized(F.lit("--/")).alias("none"))


@registered("clean_text", f"WITH {_P} SELECT p_partkey::VARCHAR AS doc_id, string_agg('[' || source || '] -> [' || target || ']', chr(10) ORDER BY i) AS text FROM p GROUP BY p_partkey")
def clean_text(s, d):
    rows = lift.parts(s, d).select("doc_id", F.struct("stmt_idx", F.concat(F.lit("["), "source", F.lit("]  ➔  ["), "target", F.lit("]  ")).alias("t")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    t = rows.select("doc_id", F.concat(F.lit("Sure!\n```\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n"), F.lit("\n```")).alias("text"))
    return repair.clean(t)


@registered("repair_text", "SELECT p_partkey::VARCHAR AS doc_id, '[P_' || p_partkey || '] -> [B] ::mod(rule=\"causal\", confidence=' || CASE WHEN p_partkey % 2 = 0 THEN '1.0' ELSE '0.0' END || ', source=\"x, y)\", n=' || p_partkey || ')' AS text, CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 5 END AS n_repairs FROM part")
def repair_text(s, d):
    text = F.concat(F.format_string("P_%d -> [B] mod(rule=causal, confidence=", "p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "1.5").otherwise("-0.5"), F.format_string(', soruce="x, y)", n=%d)', "p_partkey"))
    return repair.repair(lift.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), text.alias("text"))).select("doc_id", "text", F.size("repairs").alias("n_repairs"))


@registered("validate_output", "SELECT p_partkey::VARCHAR AS doc_id, 'P_' || p_partkey AS source, 'causal' AS rule FROM part")
def validate_output(s, d):
    text = F.format_string("Here you are:\n```\n[P_%d] => [B] mod(\n rule=causal,\n confience=0.5)\n```", "p_partkey")
    doc, _, _ = repair.validate_output(lift.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), text.alias("text")))
    return doc.statements.select("doc_id", "source", F.col("modifiers.rule").alias("rule"))


@registered("decay_effective", f"WITH {_O} SELECT source, target, round({_EFF}, 6) AS effective FROM o")
def decay_effective(s, d):
    return lift.orders(s, d).select("source", "target", F.round(decay.effective_confidence(365, REFERENCE), 6).alias("effective"))


@registered("decay_rows", f"WITH {_O}, e AS (SELECT *, {_EFF} AS x, {_AGE} AS age FROM o) SELECT source, target, round(age, 6) AS age_days, round(CASE WHEN x < 0.01 THEN 0 ELSE x END, 6) AS effective, round(CASE WHEN confidence > 0 THEN CASE WHEN x < 0.01 THEN 0 ELSE x END / confidence ELSE 1 END, 6) AS decay_ratio FROM e")
def decay_rows(s, d):
    out = decay.decay_rows(lift.orders(s, d), 365, REFERENCE)
    return out.select("source", "target", *[F.round(c, 6).alias(c) for c in ("age_days", "effective", "decay_ratio")])


@registered("decay_summary", f"WITH {_O}, e AS (SELECT confidence AS c, CASE WHEN {_EFF} < 0.01 THEN 0 ELSE {_EFF} END AS e FROM o) SELECT count(*) AS total, count(*) AS with_timestamp, count(*) FILTER (e < c) AS decayed, round(avg(e), 6) AS mean, round(median(e), 6) AS median, round(min(e), 6) AS min, round(max(e), 6) AS max, count(e) AS count FROM e")
def decay_summary(s, d):
    out = decay.decay_summary(lift.orders(s, d), 365, REFERENCE)
    return out.select("total", "with_timestamp", "decayed", *[F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max")], "count")


@registered("decay_filter", f"WITH {_O} SELECT source, target, round({_EFF}, 6) AS effective FROM o WHERE {_EFF} >= 0.25")
def decay_filter(s, d):
    out = decay.filter_by_confidence(lift.orders(s, d), 0.25, 365, REFERENCE)
    return out.select("source", "target", F.round(decay.effective_confidence(365, REFERENCE), 6).alias("effective"))


def _two(s, d) -> tuple[DataFrame, DataFrame]:
    """Orders, and a changed copy: a third gone, a third with another rule, and some new."""
    a = lift.orders(s, d)
    k = F.col("stmt_idx")
    rule = F.when(k % 3 == 1, "changed").otherwise(F.col("modifiers.rule"))
    b = a.where(k % 3 != 0).withColumn("modifiers", F.col("modifiers").withField("rule", rule))
    new = a.where(k % 10 == 0).withColumns({"target": F.concat(F.lit("new_"), "target"), "stmt_idx": k + 1_000_000})
    return a, b.unionByName(new)


_AB = f"{_O}, d AS (SELECT source, target, k, rule, CASE k % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'modify' ELSE 'unchanged' END AS op FROM o UNION ALL SELECT source, 'new_' || target, k, rule, 'add' FROM o WHERE k % 10 = 0)"


@registered("diff_entries", f"WITH {_AB} SELECT op, '[Customer:' || source || '] -> [Order:' || target || ']' AS key, CASE WHEN op <> 'add' THEN k ELSE -1 END::INTEGER AS index_a, CASE WHEN op = 'add' THEN k + 1000000 WHEN op = 'modify' THEN k ELSE -1 END::INTEGER AS index_b FROM d WHERE op <> 'unchanged'")
def diff_entries(s, d):
    return diff.diff(*_two(s, d)).select("op", "key", F.coalesce("index_a", F.lit(-1)).alias("index_a"), F.coalesce("index_b", F.lit(-1)).alias("index_b"))


@registered("diff_summary", f"WITH {_AB} SELECT count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'remove') AS removed, count(*) FILTER (op = 'modify') AS modified, count(*) FILTER (op = 'unchanged') AS unchanged, count(*) FILTER (op <> 'add') AS total_a, count(*) FILTER (op <> 'remove') AS total_b FROM d")
def diff_summary(s, d):
    return diff.diff_summary(*_two(s, d))


@registered("diff_changes", f"""WITH {_AB} SELECT '[Customer:' || source || '] -> [Order:' || target || ']' AS key, 'rule' AS field, '"' || rule || '"' AS old_value, '"changed"' AS new_value FROM d WHERE op = 'modify'""")
def diff_changes(s, d):
    return diff.diff(*_two(s, d)).where("op = 'modify'").select("key", F.explode("modifier_changes").alias("c")).select("key", "c.*")


@registered("diff_text", f"""WITH {_AB} SELECT '~ [Customer:' || source || '] -> [Order:' || target || '] rule: "' || rule || '" -> "changed"' AS line FROM d WHERE op = 'modify'""")
def diff_lines(s, d):
    return diff.diff_text(diff.diff(*_two(s, d)).where("op = 'modify'")).select("line")


@registered("patch_roundtrip", f"WITH {_O}, b AS (SELECT source, target, k, CASE WHEN k % 3 = 1 THEN 'changed' ELSE rule END AS rule FROM o WHERE k % 3 <> 0 UNION ALL SELECT source, 'new_' || target, k + 1000000, rule FROM o WHERE k % 10 = 0) SELECT source, target, rule, (row_number() OVER (ORDER BY k) - 1)::INTEGER AS stmt_idx FROM b")
def patch_roundtrip(s, d):
    a, b = _two(s, d)
    return diff.patch(a, diff.diff(a, b), b).select("source", "target", F.col("modifiers.rule").alias("rule"), "stmt_idx")


_E = "e AS (SELECT 'U_' || user_id AS src, event_type AS dst FROM events)"
_ENDS = f"{_O}, n AS (SELECT '[Customer:' || source || ']' AS node FROM o UNION ALL SELECT '[Order:' || target || ']' FROM o)"


@registered("graph_summary", f"WITH {_ENDS} SELECT count(DISTINCT node) AS nodes, (SELECT count(*) FROM o) AS edges FROM n")
def graph_summary(s, d):
    return graph.summary(lift.orders(s, d))


@registered("graph_nodes", f"WITH {_P} SELECT DISTINCT '[' || name || ']' AS node, name FROM (SELECT source AS name FROM p UNION ALL SELECT target FROM p)")
def graph_nodes(s, d):
    return graph.nodes(lift.parts(s, d)).select("node", "name")


@registered("node_degree", f"WITH {_ENDS} SELECT node, count(*) AS degree FROM n GROUP BY node")
def node_degree(s, d):
    return graph.degrees(lift.orders(s, d))


@registered("centrality_top", f"WITH {_ENDS}, g AS (SELECT node, count(*) AS degree FROM n GROUP BY node) SELECT node, degree, round(degree / ((SELECT count(*) FROM g) - 1), 9) AS centrality FROM g ORDER BY degree DESC, node LIMIT 5")
def centrality_top(s, d):
    return graph.top_central(lift.orders(s, d)).select("node", "degree", F.round("centrality", 9).alias("centrality"))


_T = "t AS (SELECT DISTINCT a, b FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"


@registered("simple_paths", f"WITH RECURSIVE {_T}, w AS (SELECT [a, b] AS path, b AS last FROM t WHERE a = 'view' AND b <> 'view' UNION ALL SELECT list_append(w.path, t.b), t.b FROM w JOIN t ON w.last = t.a WHERE w.last <> 'purchase' AND NOT list_contains(w.path, t.b)) SELECT '[' || array_to_string(path, ']>[') || ']' AS path FROM w WHERE last = 'purchase'")
def simple_paths(s, d):
    return graph.simple_paths(lift.transitions(s, d), "[view]", "[purchase]").select(F.array_join("path", ">").alias("path"))


@registered("cycles", f"WITH RECURSIVE {_T}, w AS (SELECT [a, b] AS path, a AS first, b AS last FROM t WHERE b > a UNION ALL SELECT list_append(w.path, t.b), w.first, t.b FROM w JOIN t ON w.last = t.a WHERE t.b > w.first AND NOT list_contains(w.path, t.b)) SELECT '[' || array_to_string(path, ']>[') || ']' AS cycle FROM w JOIN t ON w.last = t.a AND t.b = w.first UNION ALL SELECT '[' || a || ']' FROM t WHERE a = b")
def all_cycles(s, d):
    return graph.cycles(lift.transitions(s, d)).select(F.array_join("cycle", ">").alias("cycle"))


@registered("subgraph_domain", "SELECT 'O_' || l_orderkey AS source, 'P_' || l_partkey AS target FROM lineitem WHERE l_returnflag = 'R'")
def subgraph_domain(s, d):
    return graph.subgraph(lift.lineitem(s, d), "R").select("source", "target")


_CONF = f"{_P}, c AS (SELECT source, count(DISTINCT target) AS n, sum(confidence) AS t, string_agg(target, '|' ORDER BY i) AS targets FROM p GROUP BY source HAVING count(DISTINCT target) > 1)"


@registered("conflicts", f"WITH {_CONF} SELECT '[' || source || ']' AS source, 'is_a' AS relation, targets, n AS n_targets, round(t, 6)::DOUBLE AS tension_score FROM c")
def conflicts(s, d):
    return graph.conflicts(lift.parts(s, d)).select("source", "relation", F.array_join("targets", "|").alias("targets"), "n_targets", F.round("tension_score", 6).alias("tension_score"))


@registered("tension_metrics", f"WITH {_CONF} SELECT count(*) AS conflict_count, round(coalesce(sum(t), 0), 3)::DOUBLE AS total_tension, round(coalesce(avg(t), 0), 6)::DOUBLE AS average_tension FROM c")
def tension_metrics(s, d):
    return graph.tension_metrics(lift.parts(s, d)).select("conflict_count", F.round("total_tension", 3).alias("total_tension"), F.round("average_tension", 6).alias("average_tension"))


@registered("counts", f"WITH {_ENDS} SELECT (SELECT count(*) FROM o) AS total_statements, (SELECT count(DISTINCT (source, target)) FROM o) AS unique_statements, count(DISTINCT node) AS unique_anchors FROM n")
def counts(s, d):
    return stats.counts(lift.orders(s, d))


@registered("anchor_types", "SELECT 'overall' AS role, CASE WHEN name IN ('error', 'view', 'click', 'purchase', 'signup') THEN 'Concept' ELSE 'Concept' END AS type, count(*) AS count FROM (SELECT 'U_' || user_id AS name FROM events UNION ALL SELECT event_type FROM events) GROUP BY 1, 2")
def anchor_types(s, d):
    return stats.anchor_types(lift.events(s, d))


@registered("path_types", f"WITH {_O} SELECT CASE rule WHEN 'causal' THEN 'Causal' WHEN 'logical' THEN 'Inferential' WHEN 'empirical' THEN 'Inferential' WHEN 'definitional' THEN 'Semantic' ELSE 'UNKNOWN' END AS path_type, count(*) AS count FROM o GROUP BY 1")
def path_types(s, d):
    return stats.path_types(lift.orders(s, d))


@registered("modifier_usage", "WITH m AS (SELECT 'confidence' AS key, round(1 - 10 * l_discount, 6) AS x FROM lineitem UNION ALL SELECT 'strength', l_tax FROM lineitem UNION ALL SELECT 'qty', l_quantity FROM lineitem UNION ALL SELECT 'domain', NULL FROM lineitem UNION ALL SELECT 'timestamp', NULL FROM lineitem) SELECT key, count(*) AS frequency, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 4) AS mean FROM m GROUP BY key")
def modifier_usage(s, d):
    return stats.modifier_usage(lift.lineitem(s, d)).select("key", "frequency", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean")])


@registered("modifier_top", "WITH v AS (SELECT l_returnflag AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY l_returnflag) SELECT value, n AS count FROM v WHERE r <= 3")
def modifier_top(s, d):
    return stats.modifier_usage(lift.lineitem(s, d)).where("key = 'domain'").select(F.explode("top_values").alias("t")).select("t.*")


@registered("confidence_metrics", f"WITH {_O} SELECT 'confidence' AS metric, count(*) AS count, round(min(confidence), 6) AS min, round(max(confidence), 6) AS max, round(avg(confidence), 6) AS mean FROM o")
def confidence_metrics(s, d):
    return stats.confidence_metrics(lift.orders(s, d)).select("metric", "count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")])


@registered("missing_provenance", f"WITH {_P} SELECT source, target FROM p WHERE confidence >= 0.85")
def missing_provenance(s, d):
    return stats.missing_provenance(lift.parts(s, d)).select("source", "target")


@registered("duplicates", "SELECT user_id::VARCHAR AS doc_id, event_id::INTEGER AS stmt_idx FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r > 1")
def duplicates(s, d):
    return stats.duplicates(lift.events(s, d)).select("doc_id", "stmt_idx")


@registered("validate_codes", f"WITH {_O}, i AS (SELECT 'W003' AS code FROM o WHERE confidence < 0.5 UNION ALL SELECT 'W002' FROM o WHERE regexp_matches(source, '[0-9]{{3,}}') UNION ALL SELECT 'W002' FROM o WHERE regexp_matches(target, '[0-9]{{3,}}')) SELECT code, count(*) AS n FROM i GROUP BY code")
def validate_codes(s, d):
    return validate.diagnostics(lift.orders(s, d)).groupBy("code").agg(F.count("*").alias("n"))


@registered("validate_rules", "SELECT 'Customer' AS field, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'rule', count(*) FROM orders WHERE o_orderkey % 5 = 1 UNION ALL SELECT 'necessity', count(*) FROM orders WHERE o_orderkey % 5 = 2 UNION ALL SELECT 'time', count(*) FROM orders WHERE o_orderkey % 5 = 3")
def validate_rules(s, d):
    k = F.col("stmt_idx") % 5
    m = F.col("modifiers").withField("rule", F.when(k == 1, "guess").otherwise("causal")).withField("necessity", F.when(k == 2, "Maybe")).withField("time", F.when(k == 3, "2024-02-30"))
    bad = lift.orders(s, d).withColumns({"modifiers": m, "source_type": F.when(k == 0, "Thing")})
    out = validate.diagnostics(bad).where("severity = 'error'")
    return out.groupBy(F.when(F.col("code") == "E108", "Customer").otherwise(F.col("field")).alias("field")).agg(F.count("*").alias("n"))


@registered("valid_statements", f"WITH {_P} SELECT source, target, TRUE AS ok FROM p")
def valid_statements(s, d):
    return lift.parts(s, d).select("source", "target", validate.is_valid_statement().alias("ok"))


@registered("valid_names", "SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z0-9_][A-Za-z0-9_-]*$') AS name_ok, regexp_matches(p_brand, '^[A-Za-z0-9_][A-Za-z0-9_-]*$') AS brand_ok FROM part")
def valid_names(s, d):
    return lift.table(s, d, "part").select("p_partkey", valid_name("p_name").alias("name_ok"), valid_name("p_brand").alias("brand_ok"))


@registered("valid_datetimes", "SELECT o_orderkey, o_orderkey % 4 < 2 AS ok FROM orders")
def valid_datetimes(s, d):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, "2024-13-01").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return lift.table(s, d, "orders").select("o_orderkey", F.coalesce(valid_datetime(t), F.lit(False)).alias("ok"))


@registered("infer_types", "SELECT user_id, event_type, 'Concept' AS type, CASE WHEN event_type = 'error' THEN 'Concept' ELSE 'Concept' END AS target_type, 'Name' AS source_kind FROM events")
def infer_types(s, d):
    return lift.table(s, d, "events").select("user_id", "event_type", infer.analysis_type(F.concat(F.lit("U_"), "user_id")).alias("type"), infer.anchor_type("event_type").alias("target_type"), infer.anchor_type(F.concat(F.lit("U_"), "user_id")).alias("source_kind"))


@registered("infer_path", f"WITH {_O} SELECT target, CASE rule WHEN 'causal' THEN 'Causal' WHEN 'logical' THEN 'Inferential' WHEN 'definitional' THEN 'Semantic' END AS path_type FROM o")
def infer_path(s, d):
    return lift.orders(s, d).select("target", infer.path_type().alias("path_type"))


SCHEMA = """schema Orders v1.0 {
  namespace "Orders"
  anchor source { namespace: required("Customer") pattern: /C_\\d+/ }
  anchor target { pattern: /O_\\d*[02468]/ }
  modifier {
    required: [confidence, rule, author]
    optional: [domain]
    confidence: float(0.0, 0.75)
    rule: enum("causal", "logical", "empirical")
    domain: string
  }
  constraints { max_statements: 10 min_statements: 1 }
}"""


@registered("schema_violations", f"WITH {_O} SELECT 'target' AS field, 'E601' AS code, count(*) AS n FROM o WHERE k % 2 = 1 UNION ALL SELECT 'author', 'E601', count(*) FROM o UNION ALL SELECT 'confidence', 'E603', count(*) FROM o WHERE confidence > 0.75 UNION ALL SELECT 'rule', 'E603', count(*) FROM o WHERE rule NOT IN ('causal', 'logical', 'empirical') UNION ALL SELECT 'statements', 'E601', 1")
def schema_violations(s, d):
    return conform.conformance(lift.orders(s, d), conform.parse_schema(SCHEMA)).groupBy("field", "code").agg(F.count("*").alias("n"))


@registered("rdf_triples", f"WITH {_P} SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'iri' AS kind, source, target FROM p UNION ALL SELECT 'iri', source || i || x, target FROM p, range(4) r(x) UNION ALL SELECT 'double', source || i, target FROM p UNION ALL SELECT 'string', source || i, target FROM p) GROUP BY kind")
def rdf_triples(s, d):
    return sinks.triples(lift.parts(s, d)).groupBy("kind").agg(F.count("*").alias("n"))


@registered("ntriples", f"""WITH {_P} SELECT DISTINCT '<http://example.org/edges#' || source || '> <http://example.org/edges#relatedTo> <http://example.org/edges#' || target || '> .' AS value FROM p""")
def ntriples(s, d):
    return sinks.ntriples(lift.parts(s, d)).where(F.col("value").contains("#relatedTo>") & F.col("value").startswith("<"))


@registered("json_render", f"""WITH {_P} SELECT '{{"source":"' || source || '","target":"' || target || '","relation":"is_a"}}' AS json FROM p""")
def json_render(s, d):
    return sinks.to_json(lift.parts(s, d), ["source", "target", "relation"]).select("json")


@registered("json_roundtrip", f"WITH {_P} SELECT p_partkey::VARCHAR AS doc_id, i AS stmt_idx, source, target, confidence::DOUBLE AS confidence, 'is_a' AS relation FROM p")
def json_roundtrip(s, d):
    rows = from_json(sinks.documents_json(lift.parts(s, d)), strict=False)
    return rows.select("doc_id", "stmt_idx", "source", "target", F.col("modifiers.confidence").alias("confidence"), query.field("relation").alias("relation"))


@registered("csv_table", f"WITH {_P} SELECT source, target, confidence::VARCHAR AS confidence, NULL::VARCHAR AS rule FROM p")
def csv_table(s, d):
    return sinks.table(lift.parts(s, d))


@registered("stream_lines", "SELECT p_partkey::VARCHAR AS doc_id, line::INTEGER AS line, 'P_' || p_partkey AS source FROM part, (VALUES (1), (4), (6)) v(line)")
def stream_lines(s, d):
    text = F.format_string("[P_%1$d] -> [B] -> [C]\n# note\n\n[P_%1$d] -> [D] ::mod(\nconfidence=0.5)\n[P_%1$d] -> [E]\n[P_%1$d] -> \n", "p_partkey")
    return reader.line_statements(lift.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), text.alias("text")), on_error="skip").select("doc_id", "line", "source")


@registered("defaults_fill", f"WITH {_P} SELECT source, target, 1.0::DOUBLE AS confidence, 'definitional' AS rule FROM p")
def defaults_fill(s, d):
    bare = lift.parts(s, d).withColumn("modifiers", F.col("modifiers").withField("confidence", F.lit(None).cast("double")))
    return protocol.defaults(bare).select("source", "target", F.col("modifiers.confidence").alias("confidence"), F.col("modifiers.rule").alias("rule"))


@registered("superseded", "WITH e AS (SELECT 'U_' || user_id AS source, event_type AS target, json_extract_string(props, '$.k') AS v, date_trunc('second', ts) AS ts, user_id::VARCHAR AS d, event_id FROM events), w AS (SELECT *, first(target) OVER (PARTITION BY source, v ORDER BY ts DESC, d DESC, event_id DESC) AS newest FROM e) SELECT source, target, v AS meta_value, newest FROM w WHERE newest <> target")
def superseded(s, d):
    out = protocol.superseded(lift.events(s, d), ["k"])
    return out.select("source", "target", "meta_value", F.regexp_replace("superseded_by", r"^\[Event:|\]$", "").alias("newest"))


@registered("intrinsic_properties", "SELECT '[P_' || p_partkey || ']' AS node, '\"' || p_brand || '\"' AS brand, p_size::VARCHAR AS size FROM part")
def intrinsic_properties(s, d):
    from ..sources.build import statements_from

    p = lift.table(s, d, "part")
    name = F.concat(F.lit("P_"), F.col("p_partkey").cast("string"))
    rows = statements_from(p, name, name, doc_id=F.col("p_partkey"), extra={"action": F.lit('"intrinsic_properties"'), "brand": F.concat(F.lit('"'), "p_brand", F.lit('"')), "size": F.col("p_size").cast("string")})
    return protocol.node_attributes(rows).select("node", F.element_at("attributes", "brand").alias("brand"), F.element_at("attributes", "size").alias("size"))


@registered("confidence_levels", "WITH l(x) AS (VALUES (1.0), (0.95), (0.85), (0.7), (0.5), (0.3)), o AS (SELECT o_orderkey AS k, least(o_totalprice / 500000, 1.0) AS c FROM orders), n AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY abs(c - x::DOUBLE), x DESC) AS r FROM o, l) SELECT x::DOUBLE AS level, count(*) AS n FROM n WHERE r = 1 GROUP BY x")
def confidence_levels(s, d):
    return lift.orders(s, d).groupBy(protocol.confidence_level().alias("level")).agg(F.count("*").alias("n"))


@registered("propagation", "SELECT 'O_' || l_orderkey AS source, 'P_' || l_partkey AS target, l_linenumber - 1 AS stmt_idx, round(round(1 - 10 * l_discount, 6), 6) AS weight, round(round(1 - 10 * l_discount, 6) + l_tax, 6) AS tension FROM lineitem")
def propagation(s, d):
    return lift.lineitem(s, d).select("source", "target", "stmt_idx", F.round(protocol.propagation_weight(), 6).alias("weight"), F.round(protocol.tension_magnitude(), 6).alias("tension"))


@registered("windowed_counts", f"WITH {_O} SELECT date_trunc('day', ts) AS day, rule, count(*) AS n FROM o GROUP BY 1, 2")
def windowed_counts(s, d):
    out = reader.windowed_counts(lift.orders(s, d), window="1 day")
    return out.select(F.col("window.start").alias("day"), F.col("key").alias("rule"), "n")


__all__ = ["ORACLES", "QUERIES", "canonical", "entry"]
