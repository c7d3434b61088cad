"""Text, JSON, CSV and triples of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import anchor_id, canonical, number_text, pairs, unquoted
from ..model import DOUBLES, FIELDS
from ..operators.query import field

BASE = "http://example.org/edges#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def canonical_text(statements: DataFrame) -> DataFrame:
    """doc_id, stmt_idx, text."""
    return statements.select("doc_id", "stmt_idx", canonical().alias("text"))


def document_text(statements: DataFrame) -> DataFrame:
    """doc_id, text: the statements of a document in order, a line each."""
    rows = canonical_text(statements).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("stmt_idx", "text"))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def _json_struct() -> Column:
    end = lambda p: F.struct(F.col(p).alias("name"), F.col(f"{p}_namespace").alias("namespace"), F.col(f"{p}_type").alias("type"))
    mods = F.when(F.col("has_modifiers"), F.map_from_entries(F.transform(pairs(), lambda p: F.struct(p["key"], unquoted(p["value"])))))
    return F.struct(end("source").alias("source"), end("target").alias("target"), "arrow", "path_type", mods.alias("modifiers"))


def to_json(statements: DataFrame, fields: list[str] | None = None, keep_nulls: bool = False) -> DataFrame:
    """doc_id, stmt_idx, json of each statement, or of some of its fields."""
    body = F.struct(*[field(f).alias(f) for f in fields]) if fields else _json_struct()
    return statements.select("doc_id", "stmt_idx", F.to_json(body, {"ignoreNullFields": str(not keep_nulls).lower()}).alias("json"))


def documents_json(statements: DataFrame) -> DataFrame:
    """doc_id, json: {"statements": [...]} in order, as ``from_json`` reads it."""
    rows = statements.select("doc_id", F.struct("stmt_idx", _json_struct().alias("s")).alias("r"))
    rows = rows.groupBy("doc_id").agg(F.collect_list("r").alias("l"))
    ordered = F.transform(F.array_sort("l", lambda a, b: a["stmt_idx"] - b["stmt_idx"]), lambda r: r["s"])
    return rows.select("doc_id", F.to_json(F.struct(ordered.alias("statements"))).alias("json"))


def table(statements: DataFrame, fields=("source", "target", "confidence", "rule")) -> DataFrame:
    """The fields as text columns, for CSV."""
    return statements.select(*[(number_text(field(f)) if f in DOUBLES else field(f)).alias(f) for f in fields])


def write_csv(statements: DataFrame, path: str, fields=("source", "target", "confidence", "rule")) -> None:
    table(statements, fields).write.csv(path, header=True)


def triples(statements: DataFrame, base: str = BASE) -> DataFrame:
    """subject, predicate, object, kind (iri, blank, string, double) of statements.

    Each statement gives a direct triple (once for all alike), a reified statement
    (four triples) and a triple a modifier.
    """
    iri = lambda p: F.concat(F.lit(base), F.when(F.coalesce(F.col(f"{p}_namespace"), F.lit("")) != "", F.concat(F.col(f"{p}_namespace"), F.lit("."), F.col(p))).otherwise(F.col(p)))
    predicate = F.concat(F.lit(base), F.coalesce(F.nullif("modifiers.rule", F.lit("")), F.lower("path_type"), F.lit("relatedTo")))
    node = F.concat(F.lit("_:s"), F.regexp_replace("doc_id", r"\W", "_"), F.lit("_"), F.col("stmt_idx"))
    rows = statements.select(iri("source").alias("s"), predicate.alias("p"), iri("target").alias("o"), node.alias("n"), pairs().alias("m"))
    one = lambda s, p, o, kind: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"), F.lit(kind).alias("kind"))
    reified = F.array(one(F.col("n"), F.lit(f"{RDF}type"), F.lit(f"{RDF}Statement"), "iri"), one(F.col("n"), F.lit(f"{RDF}subject"), F.col("s"), "iri"), one(F.col("n"), F.lit(f"{RDF}predicate"), F.col("p"), "iri"), one(F.col("n"), F.lit(f"{RDF}object"), F.col("o"), "iri"))
    mods = F.transform("m", lambda x: F.struct(F.col("n").alias("subject"), F.concat(F.lit(base), x["key"]).alias("predicate"), unquoted(x["value"]).alias("object"), F.when(x["value"].startswith('"'), "string").otherwise("double").alias("kind")))
    direct = rows.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.lit("iri").alias("kind")).distinct()
    return direct.unionByName(rows.select(F.explode(F.concat(reified, mods)).alias("t")).select("t.*"))


def ntriples(statements: DataFrame, base: str = BASE) -> DataFrame:
    """value: a line of N-Triples each."""
    t = triples(statements, base)
    wrap = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    escaped = F.concat(F.lit('"'), F.replace(F.replace(F.col("object"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    obj = F.when(F.col("kind") == "iri", wrap(F.col("object"))).when(F.col("kind") == "string", escaped).otherwise(F.concat(escaped, F.lit(f"^^<{XSD}double>")))
    return t.select(F.concat_ws(" ", wrap(F.col("subject")), wrap(F.col("predicate")), obj, F.lit(".")).alias("value"))


def turtle(statements: DataFrame, base: str = BASE) -> DataFrame:
    """value: a Turtle block a subject."""
    lines = ntriples(statements, base).select(F.split("value", " ", 2).alias("x"))
    rows = lines.select(F.col("x")[0].alias("s"), F.regexp_replace(F.col("x")[1], r" \.$", "").alias("po")).groupBy("s").agg(F.array_sort(F.collect_list("po")).alias("po"))
    return rows.select(F.concat("s", F.lit(" "), F.array_join("po", " ;\n    "), F.lit(" .")).alias("value"))


__all__ = ["FIELDS", "anchor_id", "canonical_text", "document_text", "documents_json", "ntriples", "table", "to_json", "triples", "turtle", "write_csv"]
