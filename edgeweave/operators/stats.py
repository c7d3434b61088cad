"""Statistics of an edge table; every one is an aggregation with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.infer import analysis_path_type, analysis_type
from ..functions.values import canonical, pairs, source_id, target_id, unquoted
from .graph import cycles, summary, top_central


def counts(statements: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: total_statements, unique_anchors, unique_statements."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    texts = statements.select(canonical().alias("t")).agg(F.count("*").alias("total_statements"), distinct("t").alias("unique_statements"))
    anchors = statements.select(F.explode(F.array(source_id(), target_id())).alias("a")).agg(distinct("a").alias("unique_anchors"))
    return texts.join(F.broadcast(anchors))  # one row each


def anchor_types(statements: DataFrame) -> DataFrame:
    """role (source, target, overall), type, count; only ``overall`` infers missing types."""
    end = lambda p: F.struct(F.lit(p).alias("role"), F.col(f"{p}_type").alias("given"), F.col(p).alias("name"))
    e = statements.select(F.explode(F.array(end("source"), end("target"))).alias("e")).select("e.*")
    typed = e.where("given is not null").select("role", F.col("given").alias("type"))
    return typed.unionByName(e.select(F.lit("overall").alias("role"), analysis_type("name", "given").alias("type"))).groupBy("role", "type").agg(F.count("*").alias("count"))


def path_types(statements: DataFrame) -> DataFrame:
    return statements.select(analysis_path_type().alias("path_type")).groupBy("path_type").agg(F.count("*").alias("count"))


def modifier_usage(statements: DataFrame, top: int = 3) -> DataFrame:
    """key, frequency, min, max, mean (of numbers and booleans), top_values (by count, ties by value)."""
    rows = statements.select(F.explode(pairs()).alias("p")).select(F.col("p.key").alias("key"), F.col("p.value").alias("value"))
    number = F.when(F.col("value") == "true", 1.0).when(F.col("value") == "false", 0.0).when(~F.col("value").startswith('"'), F.col("value").try_cast("double"))
    per = rows.groupBy("key", "value").agg(F.count("*").alias("n")).withColumn("x", number)
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").desc(), "value")))
    best = F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", unquoted("value").alias("value"), "n"))))
    out = ranked.groupBy("key").agg(F.sum("n").alias("frequency"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean"), best.alias("b"))
    return out.select("key", "frequency", "min", "max", "mean", F.transform("b", lambda b: F.struct(b["value"].alias("value"), b["n"].alias("count"))).alias("top_values"))


def confidence_metrics(statements: DataFrame) -> DataFrame:
    """metric (confidence, certainty), count, min, max, mean; no row without values."""
    both = [F.struct(F.lit(f).alias("metric"), F.col(f"modifiers.{f}").alias("v")) for f in ("confidence", "certainty")]
    return statements.select(F.explode(F.array(*both)).alias("e")).where("e.v is not null").groupBy("e.metric").agg(F.count("*").alias("count"), F.min("e.v").alias("min"), F.max("e.v").alias("max"), F.avg("e.v").alias("mean"))


def _absent(name: str) -> Column:
    return F.coalesce(F.col(f"modifiers.{name}") == "", F.lit(True))


def missing_provenance(statements: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Confident statements without source, author and timestamp."""
    return statements.where((F.col("modifiers.confidence") >= threshold) & _absent("source") & _absent("author") & _absent("timestamp"))


def duplicates(statements: DataFrame) -> DataFrame:
    """The second and later statements between the same anchors of a document."""
    w = Window.partitionBy("doc_id", "source_namespace", "source", "target_namespace", "target").orderBy("stmt_idx")
    return statements.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def report(statements: DataFrame) -> dict[str, DataFrame]:
    """All statistics; share the work by caching ``statements``."""
    return {"counts": counts(statements), "anchor_types": anchor_types(statements), "path_types": path_types(statements), "modifier_usage": modifier_usage(statements), "confidence": confidence_metrics(statements), "missing_provenance": missing_provenance(statements), "graph": summary(statements), "top_central": top_central(statements), "cycles": cycles(statements)}
