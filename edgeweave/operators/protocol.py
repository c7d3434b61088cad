"""Rules of the written protocol beyond the core: defaults, superseding, node attributes, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import instant, source_id, target_id, unquoted
from ..model import FIELDS

# Fixed values.
META_DEFINITIONAL = ("is_a", "role", "type", "kind", "relation", "predicate")
META = (*META_DEFINITIONAL, "action", "status", "phase")
LEVELS = (1.0, 0.95, 0.85, 0.7, 0.5, 0.3)


def _bag(key: str) -> Column:
    return unquoted(F.element_at("extra", F.lit(key)))


def defaults(statements: DataFrame) -> DataFrame:
    """confidence 1.0 and a rule from the meta field where they are missing."""
    m = F.col("modifiers")
    any_of = F.lit(False)
    for k in META_DEFINITIONAL:
        any_of = any_of | F.coalesce(F.map_contains_key("extra", k), F.lit(False))
    has = lambda k: F.coalesce(F.map_contains_key("extra", k), F.lit(False))
    causal = m["cause"].isNotNull() | m["effect"].isNotNull() | m["strength"].isNotNull()
    rule = F.when(any_of, "definitional").when(has("action") & causal, "causal").when(has("action") | has("status"), "empirical").when(has("phase"), "temporal")
    filled = [F.coalesce(m["confidence"], F.lit(1.0)).alias(f) if f == "confidence" else F.coalesce(m["rule"], rule).alias(f) if f == "rule" else m[f].alias(f) for f in FIELDS]
    return statements.withColumns({"modifiers": F.struct(*filled), "has_modifiers": F.lit(True)})


def superseded(statements: DataFrame, fields=META) -> DataFrame:
    """Statements whose (source, meta field, value) a newer statement gives another target; newest by timestamp, then order."""
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("k"), _bag(f).alias("v")) for f in fields]), lambda e: e["v"].isNotNull())
    rows = statements.select("*", F.explode(entries).alias("e")).withColumns({"meta_field": F.col("e.k"), "meta_value": F.col("e.v")}).drop("e")
    w = Window.partitionBy(source_id(), "meta_field", "meta_value").orderBy(instant("modifiers.timestamp").desc_nulls_last(), F.col("doc_id").desc(), F.col("stmt_idx").desc())
    newest = F.first(target_id()).over(w)
    return rows.withColumns({"superseded_by": newest}).where(F.col("superseded_by") != target_id())


def node_attributes(statements: DataFrame) -> DataFrame:
    """node, attributes: self-loops with action "intrinsic_properties" describe their node."""
    loops = statements.where((source_id() == target_id()) & (_bag("action") == "intrinsic_properties"))
    rows = loops.select(source_id().alias("node"), "doc_id", "stmt_idx", F.explode(F.map_filter("extra", lambda k, v: k != "action")).alias("k", "v"))
    last = rows.groupBy("node", "k").agg(F.max_by("v", F.struct("doc_id", "stmt_idx")).alias("v"))
    return last.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))


def propagation_weight() -> Column:
    """confidence x salience x virtual_factor; 1 where missing."""
    number = lambda k: F.coalesce(_bag(k).try_cast("double"), F.lit(1.0))
    return F.coalesce("modifiers.confidence", F.lit(1.0)) * number("salience") * number("virtual_factor")


def tension_magnitude(w_certainty: float = 1.0, w_confidence: float = 1.0, w_strength: float = 1.0) -> Column:
    part = lambda f, w: w * F.coalesce(F.col(f"modifiers.{f}"), F.lit(0.0))
    return part("certainty", w_certainty) + part("confidence", w_confidence) + part("strength", w_strength)


def confidence_level() -> Column:
    """The nearest canonical level; the higher one of two equally near."""
    c = F.col("modifiers.confidence")
    near = F.array_sort(F.array(*[F.struct(F.abs(c - x).alias("d"), F.lit(-x).alias("x")) for x in LEVELS]))
    return F.when(c.isNotNull(), -near[0]["x"])
