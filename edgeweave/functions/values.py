"""Scalars over values, anchors and statements, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DOUBLES, FIELDS, RESERVED


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also within lambdas; keeps nested expressions small."""
    return F.transform(F.array(value), body)[0]


def number_text(x) -> Column:
    """A double as the text form writes it: 0.0001, 1e-05, 12345678.0, 1e+16."""
    return let(col(x), _number_text)


def _number_text(c: Column) -> Column:
    raw = c.cast("string")
    digits = F.regexp_replace(F.abs(c).cast("decimal(38,20)").cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.concat(F.when(c < 0, "-").otherwise(""), F.regexp_replace(digits, r"\.$", ".0"))
    mantissa = F.regexp_replace(F.split(raw, "E")[0], r"\.0$", "")
    power = F.get(F.split(raw, "E"), F.lit(1)).cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    moderate = (F.abs(c) >= 1e-4) & (F.abs(c) < 1e16)
    return F.when(~raw.contains("E"), raw).when(moderate, plain).otherwise(scientific)


def quoted(x) -> Column:
    """A string as a literal; escapes are not touched."""
    return F.concat(F.lit('"'), col(x), F.lit('"'))


def unquoted(x) -> Column:
    """The text of a literal."""
    c = col(x)
    return F.when(c.startswith('"'), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def anchor_id(namespace, name) -> Column:
    """[ns:name] or [name]; an empty namespace counts as none."""
    return F.concat(F.lit("["), F.concat_ws(":", F.nullif(col(namespace), F.lit("")), col(name)), F.lit("]"))


def source_id() -> Column:
    return anchor_id("source_namespace", "source")


def target_id() -> Column:
    return anchor_id("target_namespace", "target")


def pairs(modifiers="modifiers", extra="extra") -> Column:
    """The set modifiers as an array of (key, literal), by key."""
    m = col(modifiers)
    typed = []
    for f in FIELDS:
        v = m[f]
        literal = number_text(v) if f in DOUBLES else v if f == "priority" else quoted(v)
        typed.append(F.struct(F.lit(f).alias("key"), literal.alias("value")))
    open_bag = F.transform(F.map_entries(F.coalesce(col(extra), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.sort_array(F.filter(F.concat(F.array(*typed), open_bag), lambda p: p["value"].isNotNull()))


def canonical(modifiers="modifiers", extra="extra") -> Column:
    """The canonical text of a statement: ``[a] -> [b] ::mod(k=v, ...)`` with sorted keys."""
    body = F.coalesce(F.array_join(F.transform(pairs(modifiers, extra), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ", "), F.lit(""))
    shown = let(body, lambda b: F.when(b != "", F.concat(F.lit(" ::mod("), b, F.lit(")"))).otherwise(""))
    return F.concat(source_id(), F.lit(" -> "), target_id(), shown)


def sanitized(name) -> Column:
    """A valid anchor name from any text; "Unknown" if nothing is left."""
    x = F.regexp_replace(col(name), r"[^A-Za-z0-9_一-鿿؀-ۿ]+", "_")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")
    return F.when(x == "", "Unknown").otherwise(x)


def valid_name(name) -> Column:
    n = col(name)
    return n.rlike(r"(?U)^[\w一-鿿؀-ۿ぀-ヿ][\w一-鿿؀-ۿ぀-ヿ\-]*$") & (F.length(n) <= 64) & ~n.isin(*RESERVED)


def valid_namespace(namespace) -> Column:
    n = col(namespace)
    return F.coalesce(n.rlike(r"(?U)^[\w.]+$"), F.lit(True))


#: Dates and date-times that count as ISO 8601.
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
ISO_STRICT = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?)?$"


def instant(text) -> Column:
    """The timestamp of an ISO 8601 text; null if it isn't one. Without a zone: the session's, which is UTC."""
    t = col(text)
    return F.when(t.rlike(ISO), F.try_to_timestamp(t))


def valid_datetime(text) -> Column:
    """Whether a text is a strict ISO 8601 date or date-time; null for null."""
    t = col(text)
    return F.when(t.isNotNull(), t.rlike(ISO_STRICT) & F.try_to_timestamp(t).isNotNull())
