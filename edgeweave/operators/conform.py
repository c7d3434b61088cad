"""Conformance to a written schema: read on the driver, enforced as predicates.

Constraints that the schema language has but that were never enforced
(boolean, datetime, max_chain_length, allow_cycles) are read and, by default,
left alone; ``strict`` enforces the value types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.values import valid_datetime
from ..model import DOUBLES, FIELDS
from .query import _as_text
from .query import field as value_of


@dataclass
class FieldRule:
    type: str
    low: float | None = None
    high: float | None = None
    values: list[str] = field(default_factory=list)
    pattern: str | None = None


@dataclass
class AnchorRule:
    namespace: str | None = None
    pattern: str | None = None


@dataclass
class Schema:
    name: str
    version: str = "1.0"
    namespace: str | None = None
    source: AnchorRule | None = None
    target: AnchorRule | None = None
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    fields: dict[str, FieldRule] = field(default_factory=dict)
    limits: dict[str, int | bool] = field(default_factory=dict)


_TOKEN = re.compile(r"""\#[^\n]*|\s+|(?P<text>"[^"]*"|'[^']*')|(?P<regex>/[^/\n]+/)|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_][\w.\-]*)|(?P<mark>[{}()\[\]:,])""")


class _Reader:
    """Recursive descent; keywords are whole words."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError("E600", f"at {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group().strip("\"'") if m.lastgroup == "text" else m.group()))
            at = m.end()
        self.at = 0

    def look(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        got = self.look()
        if self.at >= len(self.tokens) or (want is not None and got != want):
            raise SchemaError("E600", f"{want or 'a token'} expected, {got or 'the end'} found")
        self.at += 1
        return got

    def block(self, entry) -> None:
        self.take("{")
        while self.look() != "}":
            entry()
        self.take("}")

    def listed(self, close: str) -> list[str]:
        out = []
        while self.look() != close:
            x = self.take()
            if x != ",":
                out.append(x)
        self.take(close)
        return out

    def schema(self) -> Schema:
        self.take("schema")
        out = Schema(self.take())
        if self.look() != "{":
            out.version = self.take().removeprefix("v")

        def entry() -> None:
            word = self.take()
            if word == "namespace":
                out.namespace = self.take()
            elif word == "anchor":
                role = self.take()
                setattr(out, role if role in ("source", "target") else "_other", self.anchor())
            elif word == "modifier":
                self.block(lambda: self.modifier(out))
            elif word == "constraints":
                self.block(lambda: self.limit(out))

        self.block(entry)
        return out

    def anchor(self) -> AnchorRule:
        out = AnchorRule()

        def entry() -> None:
            key = self.take()
            self.take(":")
            value = self.take()
            if key == "namespace":
                if value == "required":
                    self.take("(")
                    out.namespace = self.take()
                    self.take(")")
                elif value != "optional":
                    out.namespace = value
            elif key == "pattern":
                out.pattern = value[1:-1] if value.startswith("/") and value.endswith("/") else value

        self.block(entry)
        return out

    def modifier(self, out: Schema) -> None:
        key = self.take()
        self.take(":")
        if key in ("required", "optional") and self.look() == "[":
            self.take("[")
            setattr(out, key, self.listed("]"))
            return
        rule = FieldRule(self.take())
        if self.look() == "(":
            self.take("(")
            args = self.listed(")")
            if rule.type in ("float", "integer"):
                rule.low, rule.high = (float(args[i]) if len(args) > i else None for i in range(2))
            elif rule.type == "enum":
                rule.values = args
        out.fields[key] = rule

    def limit(self, out: Schema) -> None:
        key = self.take()
        self.take(":")
        value = self.take()
        out.limits[key] = value == "true" if value in ("true", "false") else int(float(value))


def parse_schema(text: str) -> Schema:
    return _Reader(text).schema()


def load_schema(path_or_text: str) -> Schema:
    """A schema from a local file, or from its text."""
    if "{" in path_or_text:
        return parse_schema(path_or_text)
    try:
        with open(path_or_text, encoding="utf-8") as f:
            return parse_schema(f.read())
    except OSError as e:
        raise SchemaError("E600", str(e)) from e


def _issue(bad: Column, code: str, message: str, name: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(name).alias("field")))


def violations(schema: Schema, strict: bool = False) -> Column:
    """Array of (code, message, field) for a statement."""
    found = []
    for role, rule in (("source", schema.source), ("target", schema.target)):
        if rule and rule.namespace:
            found.append(_issue(~F.col(f"{role}_namespace").eqNullSafe(F.lit(rule.namespace)), "E601", f"namespace must be {rule.namespace}", role))
        if rule and rule.pattern:
            found.append(_issue(~F.col(role).rlike(f"^(?:{rule.pattern})$"), "E601", "name does not match the pattern", role))
    found += [_issue(value_of(f).isNull(), "E601", "required modifier is missing", f) for f in schema.required]
    for name, rule in schema.fields.items():
        v, number = value_of(name), value_of(name).try_cast("double")
        if rule.type in ("float", "integer"):
            low = number < rule.low if rule.low is not None else F.lit(False)
            high = number > rule.high if rule.high is not None else F.lit(False)
            found.append(_issue(v.isNotNull() & (number.isNull() | low | high), "E603", "number out of range", name))
        elif rule.type == "enum":
            found.append(_issue(v.isNotNull() & ~_as_text(name).isin(rule.values), "E603", "not an allowed value", name))
        elif rule.type == "string" and rule.pattern:
            found.append(_issue(~v.cast("string").rlike(f"^(?:{rule.pattern})"), "E603", "does not match the pattern", name))
        elif strict and rule.type == "boolean":
            found.append(_issue(v.isNotNull() & ~v.cast("string").isin("true", "false"), "E603", "not a boolean", name))
        elif strict and rule.type == "datetime":
            found.append(_issue(v.isNotNull() & ~valid_datetime(v.cast("string")), "E603", "not a date", name))
    empty = F.array().cast("array<struct<code:string,message:string,field:string>>")
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else empty


def conformance(statements: DataFrame, schema: Schema, strict: bool = False) -> DataFrame:
    """doc_id, statement_index (null for the document), code, message, field of all violations."""
    rows = statements.select("doc_id", F.col("stmt_idx").alias("statement_index"), F.explode(violations(schema, strict)).alias("x")).select("doc_id", "statement_index", "x.*")
    low, high = schema.limits.get("min_statements"), schema.limits.get("max_statements")
    if low is None and high is None:
        return rows
    n = statements.groupBy("doc_id").agg(F.count("*").alias("n"))
    few, many = (F.col("n") < low if low is not None else F.lit(False)), (F.col("n") > high if high is not None else F.lit(False))
    message = F.when(few, "too few statements").otherwise("too many statements")
    return rows.unionByName(n.where(few | many).select("doc_id", F.lit(None).cast("int").alias("statement_index"), F.lit("E601").alias("code"), message.alias("message"), F.lit("statements").alias("field")))


_SPARK = {"float": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def to_struct(schema: Schema) -> T.StructType:
    """The modifiers of a schema as a StructType; required ones aren't nullable; ranges and values are metadata."""
    names = [*dict.fromkeys([*schema.required, *schema.optional, *schema.fields])]
    out = []
    for n in names:
        r = schema.fields.get(n, FieldRule("float" if n in DOUBLES else "string"))
        meta = {k: v for k, v in (("type", r.type), ("low", r.low), ("high", r.high), ("values", r.values)) if v not in (None, [])}
        out.append(T.StructField(n, _SPARK.get(r.type, T.StringType()), n not in schema.required, meta))
    return T.StructType(out)


def from_struct(name: str, struct: T.StructType) -> Schema:
    kinds = {T.DoubleType: "float", T.FloatType: "float", T.LongType: "integer", T.IntegerType: "integer", T.BooleanType: "boolean", T.TimestampType: "datetime"}
    out = Schema(name)
    for f in struct.fields:
        m = f.metadata or {}
        out.fields[f.name] = FieldRule(m.get("type", kinds.get(type(f.dataType), "string")), m.get("low"), m.get("high"), list(m.get("values", [])))
        (out.optional if f.nullable else out.required).append(f.name)
    return out


def prompt(schema: Schema) -> str:
    """Instructions for writing statements that conform to a schema."""
    lines = [f"Write statements of the form [Source] -> [Target] ::mod(key=value, ...) for {schema.name}."]
    for role, rule in (("Source", schema.source), ("Target", schema.target)):
        if rule:
            lines += [f"{role} anchors" + (f" use the namespace {rule.namespace}" if rule.namespace else "") + (f" match /{rule.pattern}/" if rule.pattern else "") + "."]
    if schema.required:
        lines.append("Required: " + ", ".join(schema.required) + ".")
    if schema.optional:
        lines.append("Optional: " + ", ".join(schema.optional) + ".")
    for n, r in schema.fields.items():
        detail = f"{r.low} to {r.high}" if r.low is not None else ", ".join(r.values)
        lines.append(f"{n}: {r.type}" + (f" ({detail})" if detail else ""))
    return "\n".join(lines)


__all__ = ["FIELDS", "Schema", "conformance", "from_struct", "load_schema", "parse_schema", "prompt", "to_struct", "violations"]
