"""Built-in validation: diagnostics as arrays of one scan, exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..document import Document
from ..functions.values import valid_datetime
from ..model import ANCHOR_TYPES
from .stats import duplicates

# Fixed values of the modifiers.
RULES = ("causal", "correlative", "logical", "definitional", "empirical")
NECESSITY = ("Possible", "Contingent", "Necessary", "Impossible")
CONDITIONALITY = ("Sufficient", "Necessary", "Both", "Neither")


def _issue(when: Column, code: str, message: str, name: str) -> Column:
    kind = "warning" if code[0] == "W" else "error"
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(name).alias("field")))


def _m(name: str) -> Column:
    return F.col(f"modifiers.{name}")


def _filled(name: str) -> Column:
    return F.coalesce(_m(name) != "", F.lit(False))


def issues() -> Column:
    """The diagnostics of a statement as an array."""
    cause = _filled("cause") | _filled("effect") | F.coalesce(_m("strength") != 0, F.lit(False)) | F.coalesce(_m("rule") == "causal", F.lit(False))
    found = [_issue(~F.col(f"{p}_type").isin(*ANCHOR_TYPES), "E108", "invalid anchor type", p) for p in ("source", "target")]
    found += [_issue(~_m("rule").isin(*RULES), "E107", "invalid rule", "rule")]
    found += [_issue(~valid_datetime(f"modifiers.{f}"), "E112", "invalid date", f) for f in ("time", "timestamp")]
    found += [_issue(~_m("necessity").isin(*NECESSITY), "E105", "invalid necessity", "necessity"), _issue(~_m("conditionality").isin(*CONDITIONALITY), "E105", "invalid conditionality", "conditionality")]
    found += [_issue((F.col("path_type") == "Causal") & ~cause, "E113", "causal path without a cause", "path_type"), _issue((_m("rule") == "empirical") & (_m("necessity") == "Necessary"), "E111", "empirical rule can't be necessary", "rule")]
    found += [_issue(_m("confidence") < 0.5, "W003", "low confidence", "confidence"), _issue(~F.col("has_modifiers"), "W004", "no modifiers", "modifiers")]
    for p in ("source", "target"):
        found += [_issue(F.length(p) < 2, "W002", "very short name", p), _issue(F.col(p).rlike(r"\d{3,}"), "W002", "long number in name", p)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def diagnostics(statements: DataFrame) -> DataFrame:
    """doc_id, severity, code, message, line, statement_index, field of all statements, with W006 for duplicates."""
    own = statements.select("doc_id", "stmt_idx", F.explode(issues()).alias("x")).select("doc_id", "x.severity", "x.code", "x.message", F.lit(None).cast("int").alias("line"), F.col("stmt_idx").alias("statement_index"), "x.field")
    again = duplicates(statements).select("doc_id", F.lit("warning").alias("severity"), F.lit("W006").alias("code"), F.lit("duplicate statement").alias("message"), F.lit(None).cast("int").alias("line"), F.col("stmt_idx").alias("statement_index"), F.lit(None).cast("string").alias("field"))
    return own.unionByName(again)


def is_valid_statement() -> Column:
    return ~F.exists(issues(), lambda x: x["severity"] == "error")


def validate(document: Document, strict: bool = False) -> Document:
    """The document with its diagnostics and validity; ``strict``: warnings invalidate too."""
    found = diagnostics(document.statements)
    if document.diagnostics is not None:
        found = document.diagnostics.unionByName(found)
    counted = found if strict else found.where("severity = 'error'")
    bad = counted.select("doc_id").distinct().withColumn("__bad", F.lit(True))
    known = document.documents if document.documents is not None else document.statements.select("doc_id").distinct().withColumn("is_valid", F.lit(True))
    docs = known.join(bad, "doc_id", "left").withColumn("is_valid", F.col("is_valid") & F.col("__bad").isNull()).drop("__bad")
    return Document(document.statements, found, docs)
