"""Filter, project and address statements. All conditions are Columns; a null never matches except for eq and ne."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.values import unquoted
from ..model import DOUBLES, FIELDS, SPECIAL

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "startswith", "in")
ORDER = ("doc_id", "stmt_idx")


def field(name: str) -> Column:
    """The value of a field: a part of the statement, a typed modifier, or a literal's text from the open bag."""
    if name in SPECIAL:
        return F.col(name)
    if name == "priority":
        return unquoted(F.col("modifiers.priority"))
    return F.col(f"modifiers.{name}") if name in FIELDS else unquoted(F.element_at("extra", F.lit(name)))


def _comparable(name: str, value) -> Column:
    """The field in the type of ``value``; what can't be compared is null."""
    c = field(name)
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if number and name not in SPECIAL and name not in DOUBLES:
        raw = F.element_at("extra", F.lit(name)) if name not in FIELDS else F.col("modifiers.priority") if name == "priority" else F.lit(None).cast("string")
        return F.when(~raw.startswith('"'), raw.try_cast("double"))
    return c.cast("string") if isinstance(value, str) and name in DOUBLES else c


def _as_text(name: str) -> Column:
    from ..functions.values import number_text

    return number_text(field(name)) if name in DOUBLES else field(name)


def condition(key: str, value) -> Column:
    """``field`` or ``field__op`` and its value as a Column without nulls."""
    name, _, op = key.rpartition("__")
    if not name or op not in OPERATORS:
        name, op = key, "eq"
    yes = F.coalesce
    false = F.lit(False)
    if op in ("eq", "ne"):
        if isinstance(value, bool):
            value = str(value).lower()
        same = field(name).isNull() if value is None else _comparable(name, value).eqNullSafe(F.lit(value))
        return same if op == "eq" else ~same
    if op == "in":
        return yes(reduce(lambda a, b: a | b, [F.coalesce(_comparable(name, v) == F.lit(v), false) for v in value], false), false)
    if op in ("contains", "startswith"):
        return yes(getattr(_as_text(name), op)(str(value)), false)
    c, v = _comparable(name, value), F.lit(value)
    return yes({"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op], false)


def matches(**where) -> Column:
    return reduce(lambda a, b: a & b, [condition(k, v) for k, v in where.items()], F.lit(True))


def apply_operator(column: Column, op: str, value) -> Column:
    """One operator on any Column, for callers with their own fields."""
    if op not in OPERATORS:
        raise QueryError("E450", op)
    v = F.lit(value) if op != "in" else None
    out = {"eq": lambda: column.eqNullSafe(v), "ne": lambda: ~column.eqNullSafe(v), "gt": lambda: column > v, "gte": lambda: column >= v, "lt": lambda: column < v, "lte": lambda: column <= v, "contains": lambda: column.cast("string").contains(v), "startswith": lambda: column.cast("string").startswith(v), "in": lambda: column.isin(list(value))}
    return F.coalesce(out[op](), F.lit(False))


def find_all(statements: DataFrame, **where) -> DataFrame:
    return statements.where(matches(**where))


def find(statements: DataFrame, **where) -> DataFrame:
    """The first match in document order: at most one row, by a top-1 without a full sort."""
    return find_all(statements, **where).orderBy(*ORDER).limit(1)


def select(statements: DataFrame, *fields: str) -> DataFrame:
    """One row a statement, nulls kept; doc_id and stmt_idx keep the order."""
    return statements.select(*ORDER, *[field(f).alias(f if f not in ORDER else f"field_{f}") for f in fields])


def item(statements: DataFrame, key) -> DataFrame:
    """By position (also negative), slice, or source name, within each document."""
    if isinstance(key, str):
        return statements.where(F.col("source") == key)
    if isinstance(key, int):
        if key >= 0:
            return statements.where(F.col("stmt_idx") == key)
        n = F.count("*").over(Window.partitionBy("doc_id"))
        return statements.withColumn("__n", n).where(F.col("stmt_idx") == F.col("__n") + key).drop("__n")
    start, stop, step = key.start, key.stop, key.step or 1
    if step < 0:
        raise QueryError("E452", "slices go forward")
    out = statements
    ends = (start is not None and start < 0) or (stop is not None and stop < 0)
    if ends:
        out = out.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id")))
    at = lambda x: F.lit(x) if x >= 0 else F.greatest(F.lit(0), F.col("__n") + x)
    first = at(start) if start is not None else F.lit(0)
    out = out.where(F.col("stmt_idx") >= first)
    if stop is not None:
        out = out.where(F.col("stmt_idx") < at(stop))
    if step > 1:
        out = out.where((F.col("stmt_idx") - first) % step == 0)
    return out.drop("__n") if ends else out


def pointer(statements: DataFrame, path: str) -> DataFrame:
    """``/`` all statements; ``/i`` one; ``/i/field``, ``/i/modifiers/field``, ``/i/source/name`` ... a value."""
    parts = [p for p in path.split("/") if p]
    if not parts:
        return statements
    if not parts[0].lstrip("-").isdigit():
        raise QueryError("E451", parts[0])
    i = int(parts[0])
    if i < 0:
        raise QueryError("E452", parts[0])
    row = statements.where(F.col("stmt_idx") == i)
    if not row.limit(1).count():
        raise QueryError("E452", parts[0])
    if len(parts) == 1:
        return row
    ends = {("source",): "source", ("source", "name"): "source", ("source", "namespace"): "source_namespace", ("source", "type"): "source_type", ("target",): "target", ("target", "name"): "target", ("target", "namespace"): "target_namespace", ("target", "type"): "target_type", ("arrow",): "arrow", ("path_type",): "path_type"}
    rest = tuple(parts[1:])
    if rest in ends:
        value = F.col(ends[rest])
    elif rest[0] == "modifiers" and len(rest) == 2:
        value = F.col(f"modifiers.{rest[1]}") if rest[1] in FIELDS else field(rest[1])
    elif rest == ("modifiers",):
        value = F.col("modifiers")
    elif len(rest) == 1:
        value = field(rest[0])
    else:
        raise QueryError("E451", rest[-1])
    if rest not in ends and rest != ("modifiers",) and rest[-1] not in FIELDS and not row.where(F.col("has_modifiers") & F.map_contains_key("extra", rest[-1])).limit(1).count():
        raise QueryError("E451", rest[-1])
    return row.select("doc_id", "stmt_idx", value.alias("value"))


def typed_value(text: str):
    """A value of a where-text: number, boolean, or text without its quotes."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def where_text(text: str) -> dict:
    """``confidence__gt=0.8,rule=causal,domain__in=a|b`` as keyword arguments."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, eq, value = part.partition("=")
        if not eq:
            raise QueryError("E450", part)
        out[key.strip()] = value.strip().split("|") if key.strip().endswith("__in") else typed_value(value)
    return out


def run_query(statements: DataFrame, where: str = "", fields: str = "", limit: int | None = None, count: bool = False) -> DataFrame:
    """Filter, limit (in document order), then count or project."""
    out = find_all(statements, **where_text(where)) if where else statements
    if limit is not None:
        out = out.orderBy(*ORDER).limit(limit)
    if count:
        return out.agg(F.count("*").alias("count"))
    return select(out, *[f.strip() for f in fields.split(",")]) if fields else out
