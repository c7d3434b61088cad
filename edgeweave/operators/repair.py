"""Cleaning and repairing generated text, as Columns over the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..document import Document
from ..functions import lines as L
from ..functions.values import let
from ..sources.parse import parse_documents
from .conform import Schema, conformance


def clean(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text) with the cleaned text."""
    return texts.withColumn("text", L.cleaned("text"))


def repair(texts: DataFrame) -> DataFrame:
    """``texts`` with every line repaired, and ``repairs``: (type, line, original, repaired) of the steps that changed a line."""
    rows = F.transform(F.split("text", "\n", -1), lambda x, i: _steps(x, i + 1))
    done = texts.withColumn("__r", rows)
    text = F.array_join(F.transform("__r", lambda r: r["text"]), "\n")
    return done.withColumns({"text": text, "repairs": F.flatten(F.transform("__r", lambda r: r["repairs"]))}).drop("__r")


def _steps(line, number):
    """(text, repairs) of one line, step by step."""
    record = "array<struct<type:string,line:int,original:string,repaired:string>>"
    out = F.struct(line.alias("text"), F.array().cast(record).alias("repairs"))
    skip = L.trimmed(line).startswith("#") | (L.trimmed(line) == "")
    for name, step in L.REPAIRS:
        out = let(out, _recorded(name, step, number))
    return F.when(skip, F.struct(line.alias("text"), F.array().cast(record).alias("repairs"))).otherwise(out)


def _recorded(name, step, number):
    """A step on (text, repairs) that notes what it changed."""

    def note(s, t):
        entry = F.struct(F.lit(name).alias("type"), number.cast("int").alias("line"), s["text"].alias("original"), t.alias("repaired"))
        return F.struct(t.alias("text"), F.when(t != s["text"], F.concat(s["repairs"], F.array(entry))).otherwise(s["repairs"]).alias("repairs"))

    return lambda s: let(step(s["text"]), lambda t: note(s, t))


def validate_output(texts: DataFrame, schema: Schema | None = None) -> tuple[Document, DataFrame, DataFrame | None]:
    """Clean, repair, parse and check: (document, cleaned texts with repairs, violations)."""
    fixed = repair(clean(texts))
    doc = parse_documents(fixed.select("doc_id", "text"))
    return doc, fixed, conformance(doc.statements, schema) if schema else None
