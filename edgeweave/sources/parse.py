"""Text to edges, without Python workers: the text form is regular, so the JVM's regular expressions read it.

A text with any syntax error, or any invalid value, gives no statements at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..document import Document
from ..functions import lines as L
from ..functions.values import col, let, number_text, unquoted
from ..model import ARROW, DOUBLES, FIELDS, RESERVED

# The grammar, in Java's syntax. White space between tokens does not count.
_ID = r"[\w一-鿿؀-ۿ぀-ヿ][\w一-鿿؀-ۿ぀-ヿ\-]*+"
_ANCHOR = rf"\[\s*+(?:{_ID}\s*+(?:\.\s*+{_ID}\s*+)*+:\s*+)?+{_ID}\s*+\]"
_STRING = r'"(?:[^"\\\n]|\\.)*+"'
_DATE = r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?)?"
_NUMBER = r"-?\d+\.?\d*%?"
_VALUE = rf"(?:{_STRING}|{_DATE}|{_NUMBER}|true|false)"
_PAIR = rf"{_ID}\s*+=\s*+{_VALUE}"
_MOD = rf"::\s*+mod\s*+\(\s*+{_PAIR}(?:\s*+,\s*+{_PAIR})*+\s*+\)"
_HOP = rf"(?:->|→)\s*+{_ANCHOR}(?:\s*+{_MOD})?+"
_STATEMENT = rf"{_ANCHOR}(?:\s*+{_HOP})++"
_TEXT = rf"(?U)^(?:\s*+(?:#[^\n]*+|{_STATEMENT}))*+\s*+$"


def _checked() -> str:
    """The grammar once more, with the rules for names and values: they are regular too."""
    word = r"[\w一-鿿؀-ۿ぀-ヿ]"
    name = rf"(?!(?:{'|'.join(RESERVED)})\s*+\]){word}[\w一-鿿؀-ۿ぀-ヿ\-]{{0,63}}+"
    anchor = rf"\[\s*+(?:{word}++\s*+(?:\.\s*+{word}++\s*+)*+:\s*+)?+{name}\s*+\]"
    unit = r"(?:-?0++(?:\.0*+)?+(?![\d.%])|0++(?:\.\d*+)?+(?!%)|0*+1(?:\.0*+)?+(?![\d%])|0*+\d{1,2}(?:\.\d*+)?+%|0*+100(?:\.0*+)?+%)"
    ends = r"(?=\s*+[,)])"
    text = rf"(?:{'|'.join(f for f in FIELDS if f not in (*DOUBLES, 'priority'))})\s*+=\s*+(?:{_STRING}|{_DATE}){ends}"
    number = rf"(?:{'|'.join(DOUBLES)})\s*+=\s*+(?:{unit}|\"{unit}\"|true|false){ends}"
    other = rf"(?!(?:{'|'.join(f for f in FIELDS if f != 'priority')})\s*+=){_PAIR}"
    pair = rf"(?:{text}|{number}|{other})"
    mod = rf"::\s*+mod\s*+\(\s*+{pair}(?:\s*+,\s*+{pair})*+\s*+\)"
    return rf"(?U)^(?:\s*+(?:#[^\n]*+|{anchor}(?:\s*+(?:->|→)\s*+{anchor}(?:\s*+{mod})?+)++))*+\s*+$"


def is_valid_text(text) -> Column:
    """Whether the syntax of a text holds."""
    return col(text).rlike(_TEXT)


def _entries(mod: Column) -> Column:
    """(key, literal) of a modifier text; of repeated keys the last one counts."""
    found = F.transform(
        F.regexp_extract_all(mod, F.lit("(?U)" + _PAIR), F.lit(0)),
        lambda p: F.struct(F.regexp_extract(p, rf"(?U)^({_ID})", 1).alias("key"), F.regexp_extract(p, rf"(?U)^{_ID}\s*+=\s*+((?s:.*))$", 1).alias("value")),
    )
    return let(found, lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])))


def _number(literal: Column) -> Column:
    """The double of a literal: percentages are hundredths, true is 1, quoted numbers count."""
    bare = unquoted(literal)
    return (
        F.when(literal == "true", 1.0)
        .when(literal == "false", 0.0)
        .when(literal.endswith("%"), F.regexp_replace(literal, "%$", "").try_cast("double") / 100)
        .otherwise(bare.try_cast("double"))
    )


def _bag_literal(v: Column) -> Column:
    """An open-bag value: percentages as numbers, dates as strings."""
    return F.when(v.endswith("%") & ~v.startswith('"'), number_text(_number(v))).when(v.rlike(rf"^{_DATE}$"), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)


def _typed_sql(f: str) -> str:
    """The typed value of field ``f`` in the map of literals ``m``, as SQL: one expression for 30 fields is quick to plan."""
    v = f"element_at(m, '{f}')"
    bare = f"CASE WHEN startswith({v}, '\"') THEN substring({v}, 2, length({v}) - 2) ELSE {v} END"
    if f in DOUBLES:
        return f"CASE WHEN {v} = 'true' THEN 1D WHEN {v} = 'false' THEN 0D WHEN endswith({v}, '%') THEN try_cast(rtrim('%', {v}) AS double) / 100 ELSE try_cast({bare} AS double) END"
    if f == "priority":
        return f"CASE WHEN endswith({v}, '%') AND NOT startswith({v}, '\"') THEN CAST(try_cast(rtrim('%', {v}) AS double) / 100 AS string) WHEN {v} RLIKE r'^{_DATE}$' THEN concat('\"', {v}, '\"') ELSE {v} END"
    return bare


def _edges(texts: DataFrame) -> DataFrame:
    """One row a hop of valid texts (doc_id, body): the edge table, and whether it is the first hop of its statement.

    A valid text is anchors that begin statements, and hops; each hop goes on
    from the anchor or hop before it. Exploded before anything is taken apart,
    so that the rest runs in generated code.
    """
    anchor = "(?U)" + _ANCHOR
    tokens = F.filter(F.regexp_extract_all("body", F.lit(f"(?U)#[^\\n]*+|{_HOP}|{_ANCHOR}"), F.lit(0)), lambda x: ~x.startswith("#"))
    rows = texts.select("doc_id", tokens.alias("tokens"))
    hops = F.filter(F.transform("tokens", lambda t, i: F.struct(F.get("tokens", i - 1).alias("before"), t.alias("hop"))), lambda x: ~x["hop"].startswith("["))
    rows = rows.select("doc_id", F.posexplode(hops).alias("stmt_idx", "x")).select("doc_id", "stmt_idx", "x.*")
    inner = lambda c: F.split(F.regexp_replace(F.regexp_extract(c, anchor, 0), r"(?U)[\[\]\s]", ""), ":", 2)
    rows = rows.select("doc_id", "stmt_idx", F.col("before").startswith("[").alias("first_hop"), inner("before").alias("a"), inner("hop").alias("b"), F.regexp_extract("hop", "(?U)" + _MOD, 0).alias("mod"))
    rows = rows.withColumn("m", F.map_from_entries(_entries(F.col("mod"))))
    ns = lambda c: F.when(F.size(c) > 1, F.get(c, F.lit(0)))
    typed = F.expr("struct(" + ", ".join(f"{_typed_sql(f)} AS {f}" for f in FIELDS) + ")")
    bag = F.transform_values(F.map_filter("m", lambda k, v: ~k.isin(*FIELDS)), lambda k, v: _bag_literal(v))
    none = F.lit(None).cast("string")
    has = F.col("mod") != ""
    return rows.select(
        "doc_id", "stmt_idx", "first_hop", F.element_at("a", -1).alias("source"), ns(F.col("a")).alias("source_namespace"), none.alias("source_type"), F.element_at("b", -1).alias("target"), ns(F.col("b")).alias("target_namespace"), none.alias("target_type"),
        F.lit(ARROW).alias("arrow"), none.alias("path_type"), has.alias("has_modifiers"), F.when(has, typed).alias("modifiers"), F.when(F.size(bag) > 0, bag).alias("extra"),
    )


def extracted(text, mode: str = "auto") -> Column:
    """(format, lines as array of (text, line), total_lines) of a text after merging and extraction."""
    rows = L.merged(text)

    def by_mode(r: Column) -> Column:
        total = F.size(r).alias("total_lines")
        of = lambda name, x: F.struct(F.lit(name).alias("format"), x.alias("lines"), total)
        likely = F.filter(r, lambda m: L.line_type(m["text"]).isin(*L.STATEMENT_TYPES))
        every = {"fenced": of("fenced", L.fenced(r)), "heuristic": of("heuristic", likely), "pure": of("pure", r), "strict": of("strict", r)}
        if mode != "auto":
            return every[mode]
        fences = F.exists(r, lambda m: L.trimmed(m["text"]).startswith("```" + L.FENCE_TAG))
        return F.when(fences, every["fenced"]).when(L.is_pure(r), every["pure"]).otherwise(every["heuristic"])

    return let(rows, by_mode)


def parse_documents(texts: DataFrame, mode: str = "strict", merge: bool = True, first_hop_only: bool = False) -> Document:
    """A Document of ``texts`` (doc_id, text). Modes: strict, auto, fenced, heuristic, pure.

    Everything is an array expression over the row of a text: no shuffle.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    base = texts.select(F.col("doc_id").cast("string").alias("doc_id"), t.alias("text"))
    if mode == "strict" and not merge:
        step = base.select("doc_id", F.lit("strict").alias("format"), F.col("text").alias("body"), F.size(F.split("text", "\n", -1)).alias("total_lines"), F.lit(0).alias("broken"))
    else:
        count = lambda kind: F.size(F.filter(L.merged("text"), lambda m: L.line_type(m["text"]) == kind))
        found = base.select("doc_id", extracted("text", mode).alias("x"), (count("possible_syntax_error") if mode in ("auto", "heuristic") else F.lit(0)).alias("b"))
        body = F.array_join(F.transform("x.lines", lambda m: m["text"]), "\n")
        step = found.select("doc_id", F.col("x.format").alias("format"), body.alias("body"), F.col("x.total_lines").alias("total_lines"), F.when(F.col("x.format") == "heuristic", F.col("b")).otherwise(0).alias("broken"))
    read = step.withColumns({"syntax": is_valid_text("body"), "values": F.col("body").rlike(_checked())})
    rows = _edges(read.where("values").select("doc_id", "body"))
    statements = (rows.where("first_hop") if first_hop_only else rows).drop("first_hop")
    code = F.when(~F.col("syntax"), "E001").when(~F.col("values"), "E002").when(F.col("broken") > 0, "E003")
    message = F.when(code == "E001", "syntax error").when(code == "E002", "invalid value").otherwise("lines that look like broken statements")
    none = F.lit(None)
    diagnostics = read.where(code.isNotNull()).select("doc_id", F.lit("error").alias("severity"), code.alias("code"), message.alias("message"), none.cast("int").alias("line"), none.cast("int").alias("statement_index"), none.cast("string").alias("field"))
    documents = read.select("doc_id", (F.col("syntax") & F.col("values") & (F.col("broken") == 0)).alias("is_valid"), "format", "total_lines")
    return Document(statements, diagnostics, documents)
