"""Edges from columns, from Python values, and from JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SerializationError, ValidationError
from ..functions.values import col, number_text, quoted
from ..model import ANCHOR_TYPES, ARROW, DOUBLES, FIELDS, MODIFIERS, RESERVED, STATEMENTS

_NAME = re.compile(r"[\w一-鿿؀-ۿ぀-ヿ][\w一-鿿؀-ۿ぀-ヿ\-]*")


def anchor_columns(text) -> tuple[Column, Column]:
    """(namespace, name) of "[Ns:X]", "Ns:X", "[X]" or "X"; cut at the first colon."""
    inner = F.regexp_replace(F.trim(col(text)), r"^\[|\]$", "")
    parts = F.split(inner, ":", 2)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))), F.element_at(parts, -1)


def statements_from(df: DataFrame, source: Column, target: Column, doc_id=None, stmt_idx=None, source_namespace=None, target_namespace=None, path_type=None, extra: dict[str, Column] | None = None, **mods: Column) -> DataFrame:
    """Lifts the rows of any DataFrame to edges. ``mods`` are typed modifiers, ``extra`` values of the open bag.

    Without ``stmt_idx`` every row is statement 0 of its document.
    """
    null = F.lit(None).cast("string")
    unknown = set(mods) - set(FIELDS)
    if unknown:
        raise ValidationError("E100", f"not typed modifiers: {sorted(unknown)}")
    typed = F.struct(*[mods.get(f, F.lit(None)).cast(MODIFIERS[f].dataType).alias(f) for f in FIELDS])
    bag = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v)]) if extra else F.lit(None).cast("map<string,string>")
    return df.select(
        (doc_id if doc_id is not None else F.lit("0")).cast("string").alias("doc_id"),
        (stmt_idx if stmt_idx is not None else F.lit(0)).cast("int").alias("stmt_idx"),
        source.alias("source"),
        (source_namespace if source_namespace is not None else null).alias("source_namespace"),
        null.alias("source_type"),
        target.alias("target"),
        (target_namespace if target_namespace is not None else null).alias("target_namespace"),
        null.alias("target_type"),
        F.lit(ARROW).alias("arrow"),
        (path_type if path_type is not None else null).alias("path_type"),
        F.lit(bool(mods or extra)).alias("has_modifiers"),
        (typed if mods else F.lit(None).cast(MODIFIERS)).alias("modifiers"),
        bag.alias("extra"),
    )


def literal(value) -> str:
    """A Python value as the text form writes it."""
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int | float) else f'"{value}"'


class Statement:
    """``edge("A", "[Ns:B]").mod(confidence=0.9).build()``."""

    def __init__(self, source: str, target: str, path_type: str | None = None, source_type: str | None = None, target_type: str | None = None):
        self.source, self.target, self.path_type, self.types = source, target, path_type, (source_type, target_type)
        self.mods: dict = {}
        self.check = True

    def mod(self, **mods) -> Statement:
        self.mods |= mods
        return self

    def no_validate(self) -> Statement:
        self.check = False
        return self

    def build(self) -> dict:
        ends = []
        for text in (self.source, self.target):
            ns, _, name = text.strip().removeprefix("[").removesuffix("]").rpartition(":") if text.count(":") == 1 else _first_colon(text)
            ends.append((ns or None, name))
            if self.check and (not _NAME.fullmatch(name) or len(name) > 64 or name in RESERVED or (ns and not re.fullmatch(r"[\w.]+", ns))):
                raise ValidationError("E100", text)
        if self.check and any(t and t not in ANCHOR_TYPES for t in self.types):
            raise ValidationError("E108", str(self.types))
        given = {k: v for k, v in self.mods.items() if v is not None}
        typed = {}
        for f in FIELDS:
            v = given.get(f)
            typed[f] = None if v is None else float(v) if f in DOUBLES else literal(v) if f == "priority" else str(v)
            if self.check and f in DOUBLES and v is not None and not 0 <= float(v) <= 1:
                raise ValidationError("E105", f"{f}={v}")
        bag = {k: literal(v) for k, v in given.items() if k not in FIELDS}
        return {
            "source": ends[0][1], "source_namespace": ends[0][0], "source_type": self.types[0], "target": ends[1][1], "target_namespace": ends[1][0], "target_type": self.types[1],
            "arrow": ARROW, "path_type": self.path_type, "has_modifiers": bool(given), "modifiers": typed if given else None, "extra": bag or None,
        }


def _first_colon(text: str) -> tuple[str, str, str]:
    ns, sep, name = text.strip().removeprefix("[").removesuffix("]").partition(":")
    return (ns, sep, name) if sep else ("", "", ns)


def edge(source: str, target: str, **kw) -> Statement:
    return Statement(source, target, **kw)


def document(spark: SparkSession, *items, doc_id: str = "0"):
    """A Document of statements (built or not), in order."""
    from ..document import Document

    rows = [(x.build() if isinstance(x, Statement) else x) | {"doc_id": doc_id, "stmt_idx": i} for i, x in enumerate(items)]
    names = STATEMENTS.fieldNames()
    statements = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], STATEMENTS)
    return Document(statements, None, spark.createDataFrame([(doc_id, True)], "doc_id string, is_valid boolean"))


def from_json(df: DataFrame, column: str = "json", strict: bool = True) -> DataFrame:
    """Edges of JSON documents {"statements": [{source, target, modifiers...}]} in the column; ``doc_id`` is kept.

    ``strict`` raises for texts that aren't JSON (E201) or have no statements (E200); else they give no rows.
    """
    end = "struct<name:string,namespace:string,type:string>"
    shape = f"statements array<struct<source:{end},target:{end},arrow:string,path_type:string,modifiers:map<string,string>>>"
    read = df.withColumn("__x", F.from_json(column, shape)).withColumn("__json", F.try_parse_json(F.col(column)).isNotNull())
    if strict:
        bad = read.where(~F.col("__json") | F.col("__x.statements").isNull()).select("__json").limit(1).collect()
        if bad:
            raise SerializationError("E200" if bad[0]["__json"] else "E201")
    rows = read.select("doc_id", F.posexplode("__x.statements").alias("stmt_idx", "s"))
    m = F.col("s.modifiers")
    typed = F.struct(*[F.element_at(m, F.lit(f)).try_cast(MODIFIERS[f].dataType).alias(f) for f in FIELDS])
    bag = F.map_filter(m, lambda k, v: ~k.isin(*FIELDS) & v.isNotNull())
    shown = F.transform_values(bag, lambda k, v: F.when(v.rlike(r"^(?:-?\d+(?:\.\d+)?|true|false)$"), v).otherwise(quoted(v)))
    return rows.select(
        "doc_id", "stmt_idx", F.col("s.source.name").alias("source"), F.col("s.source.namespace").alias("source_namespace"), F.col("s.source.type").alias("source_type"),
        F.col("s.target.name").alias("target"), F.col("s.target.namespace").alias("target_namespace"), F.col("s.target.type").alias("target_type"),
        F.coalesce("s.arrow", F.lit(ARROW)).alias("arrow"), F.col("s.path_type").alias("path_type"), m.isNotNull().alias("has_modifiers"),
        F.when(m.isNotNull(), typed).alias("modifiers"), F.when(F.size(shown) > 0, shown).alias("extra"),
    )


__all__ = ["T", "anchor_columns", "document", "edge", "from_json", "literal", "number_text", "statements_from"]
