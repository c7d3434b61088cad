"""The driver's tables as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import quoted, sanitized
from ..sources.build import statements_from

RULE_OF_PRIORITY = {"1-URGENT": "causal", "2-HIGH": "logical", "3-MEDIUM": "empirical", "4-NOT SPECIFIED": "definitional", "5-LOW": "correlative"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string"))


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Customer:C_k] -> [Order:O_k], a document a customer, in order of the order key's last digit and key."""
    o = table(spark, sf_dir, "orders")
    rule = F.create_map(*[F.lit(x) for kv in RULE_OF_PRIORITY.items() for x in kv])[F.col("o_orderpriority")]
    return statements_from(
        o, _named("C", "o_custkey"), _named("O", "o_orderkey"), doc_id=F.lit("orders"), stmt_idx=F.col("o_orderkey"), source_namespace=F.lit("Customer"), target_namespace=F.lit("Order"),
        rule=rule, confidence=F.least(F.col("o_totalprice") / 500000, F.lit(1.0)), timestamp=_stamp("o_orderdate"), domain=F.col("o_orderstatus"), extra={"priority_class": quoted("o_orderpriority")},
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Order:O_k] -> [Part:P_k], a document an order."""
    x = table(spark, sf_dir, "lineitem")
    return statements_from(
        x, _named("O", "l_orderkey"), _named("P", "l_partkey"), doc_id=F.col("l_orderkey"), stmt_idx=F.col("l_linenumber") - 1, source_namespace=F.lit("Order"), target_namespace=F.lit("Part"),
        confidence=F.round(1 - 10 * F.col("l_discount"), 6), strength=F.col("l_tax"), timestamp=_stamp("l_shipdate"), domain=F.col("l_returnflag"), extra={"qty": F.col("l_quantity").cast("int").cast("string")},
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P_k] -> [brand] and [P_k] -> [type], relation is_a: every part is a conflict."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit(1).alias("k"), F.col("p_type").alias("v")))).alias("e"))
    return statements_from(p, _named("P", "p_partkey"), sanitized("e.v"), doc_id=F.col("p_partkey"), stmt_idx=F.col("e.k"), confidence=F.when(F.col("e.k") == 0, 0.9).otherwise(0.6), extra={"relation": F.lit('"is_a"')})


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers -> nation -> region, relation located_in."""
    c = table(spark, sf_dir, "customer").select(_named("C", "c_custkey").alias("s"), _named("N", "c_nationkey").alias("t"), F.lit("c").alias("d"), F.col("c_custkey").alias("i"))
    s = table(spark, sf_dir, "supplier").select(_named("S", "s_suppkey").alias("s"), _named("N", "s_nationkey").alias("t"), F.lit("s").alias("d"), F.col("s_suppkey").alias("i"))
    n = table(spark, sf_dir, "nation").select(_named("N", "n_nationkey").alias("s"), _named("R", "n_regionkey").alias("t"), F.lit("n").alias("d"), F.col("n_nationkey").alias("i"))
    return statements_from(c.unionByName(s).unionByName(n), F.col("s"), F.col("t"), doc_id=F.col("d"), stmt_idx=F.col("i"), rule=F.lit("definitional"), extra={"relation": F.lit('"located_in"')})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[User:U_k] -> [Event:type], a document a user."""
    e = table(spark, sf_dir, "events")
    return statements_from(
        e, _named("U", "user_id"), F.col("event_type"), doc_id=F.col("user_id"), stmt_idx=F.col("event_id"), source_namespace=F.lit("User"), target_namespace=F.lit("Event"),
        confidence=F.least(F.col("value") / 100, F.lit(1.0)), timestamp=_stamp("ts"), extra={"k": F.get_json_object("props", "$.k")},
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[type] -> [next type of the user]: a small cyclic graph, one statement a distinct pair."""
    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = e.select(F.col("event_type").alias("a"), nxt.alias("b")).where("b is not null").distinct()
    return statements_from(pairs, F.col("a"), F.col("b"), doc_id=F.lit("t"), stmt_idx=F.lit(0))
