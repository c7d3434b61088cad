"""The edge table as a directed multigraph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.values import source_id, target_id, unquoted
from ..storage import cut

#: Relations that should have one target.
FUNCTIONAL = ("has_color", "is_a", "located_in", "defined_as")


def edges(statements: DataFrame) -> DataFrame:
    """src, dst (ids) and every column of the statements."""
    return statements.withColumns({"src": source_id(), "dst": target_id()})


def nodes(statements: DataFrame) -> DataFrame:
    """node with the name, namespace and type of its first mention."""
    end = lambda p, k: F.struct(F.col("doc_id"), F.col("stmt_idx"), F.lit(k).alias("k"), F.col(p).alias("name"), F.col(f"{p}_namespace").alias("namespace"), F.col(f"{p}_type").alias("type"))
    ends = edges(statements).select(F.explode(F.array(F.struct(F.col("src").alias("node"), end("source", 0).alias("a")), F.struct(F.col("dst").alias("node"), end("target", 1).alias("a")))).alias("e"))
    return ends.groupBy("e.node").agg(F.min("e.a").alias("a")).select("node", "a.name", "a.namespace", "a.type")


def summary(statements: DataFrame) -> DataFrame:
    """One row: nodes, edges (parallel ones count)."""
    ends = edges(statements).select(F.explode(F.array("src", "dst")).alias("node"), F.lit(1).alias("one"))
    return ends.agg(F.count_distinct("node").alias("nodes"), (F.count("one") / 2).cast("long").alias("edges"))


def degrees(statements: DataFrame) -> DataFrame:
    """node, degree (in and out; a self-loop counts twice)."""
    return edges(statements).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree(statements: DataFrame, node: str) -> int:
    row = degrees(statements).where(F.col("node") == node).first()
    if row is None:
        raise GraphError("E302", node)
    return row["degree"]


def centrality(statements: DataFrame) -> DataFrame:
    """node, degree, centrality = degree / (nodes - 1); 1.0 for a single node."""
    d = degrees(statements)
    n = d.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n)).select("node", "degree", F.when(F.col("n") <= 1, 1.0).otherwise(F.col("degree") / (F.col("n") - 1)).alias("centrality"))


def top_central(statements: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most central nodes; ties by id."""
    return centrality(statements).orderBy(F.col("centrality").desc(), "node").limit(k)


def _adjacent(statements: DataFrame) -> DataFrame:
    """Distinct edges with their multiplicity."""
    return edges(statements).groupBy("src", "dst").agg(F.count("*").alias("m"))


def simple_paths(statements: DataFrame, start: str, end: str, max_length: int | None = None) -> DataFrame:
    """path (array of ids) and edges of every simple path; parallel edges give repeated paths. E302 for absent ends.

    A frontier join a step, each path carrying its nodes: the work follows the
    number of simple paths, which is exponential in dense graphs; ``max_length``, if
    given, bounds the edges of a path.
    """
    adj = _adjacent(statements)
    known = edges(statements).select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").isin(start, end)).distinct().count()
    if known < len({start, end}):
        raise GraphError("E302", f"{start}, {end}")
    # only nodes between the ends can be on a path
    step = adj.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"), "m").where(F.col("at") != start)
    found = None
    for _ in count() if max_length is None else range(max_length):
        step = cut(step)
        done = step.where(F.col("at") == end)
        found = done if found is None else found.unionByName(done)
        open_ = step.where(F.col("at") != end)
        if not open_.limit(1).count():
            break
        nxt = open_.alias("p").join(adj.alias("e"), F.col("p.at") == F.col("e.src"))
        step = nxt.where(~F.array_contains("p.path", F.col("e.dst"))).select(F.concat("p.path", F.array("e.dst")).alias("path"), F.col("e.dst").alias("at"), (F.col("p.m") * F.col("e.m")).alias("m"))
    return found.select("path", F.size("path").alias("length"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy")).drop("copy")


def cycles(statements: DataFrame, max_length: int | None = None) -> DataFrame:
    """cycle (array of ids, smallest first) of every simple cycle, self-loops included, each once.

    Nodes without a way in or out can't be on a cycle and are pruned first;
    paths grow only over nodes above their start, until none is open or, if
    given, over ``max_length`` steps.
    """
    adj = _adjacent(statements).select("src", "dst")
    while True:
        n = adj.count()
        ins, outs = adj.select(F.col("dst").alias("src")).distinct(), adj.select(F.col("src").alias("dst")).distinct()
        adj = cut(adj.join(ins, "src", "left_semi").join(outs, "dst", "left_semi"))
        if adj.count() == n:
            break
    found = adj.where("src = dst").select(F.array("src").alias("cycle"))
    step = adj.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("at"))
    for _ in count() if max_length is None else range(max_length):
        step = cut(step)
        if not step.limit(1).count():
            break
        nxt = step.alias("p").join(adj.alias("e"), F.col("p.at") == F.col("e.src"))
        found = found.unionByName(nxt.where(F.col("e.dst") == F.col("p.first")).select(F.col("p.path").alias("cycle")))
        grow = (F.col("e.dst") > F.col("p.first")) & ~F.array_contains("p.path", F.col("e.dst"))
        step = nxt.where(grow).select(F.concat("p.path", F.array("e.dst")).alias("path"), F.col("p.first").alias("first"), F.col("e.dst").alias("at"))
    return found


def subgraph(statements: DataFrame, domain: str) -> DataFrame:
    return statements.where(F.col("modifiers.domain") == domain)


def relation() -> Column:
    """The relation of a statement: its ``relation`` key, else its rule, else its ``path_type`` key, else generic."""
    bag = lambda k: unquoted(F.element_at("extra", F.lit(k)))
    return F.coalesce(bag("relation"), F.col("modifiers.rule"), bag("path_type"), F.lit("generic"))


def conflicts(statements: DataFrame, functional=FUNCTIONAL) -> DataFrame:
    """source, relation, targets (in document order, distinct), tension_score where a functional relation has several target names."""
    rows = edges(statements).select("src", relation().alias("relation"), "target", "doc_id", "stmt_idx", F.coalesce("modifiers.confidence", F.lit(1.0)).alias("c"))
    rows = rows.where(F.col("relation").isin(list(functional or FUNCTIONAL)))
    # one row a target first, so that a popular node's edges are summed before they meet
    per = rows.groupBy("src", "relation", "target").agg(F.sum("c").alias("c"), F.min(F.struct("doc_id", "stmt_idx")).alias("at"))
    out = per.groupBy("src", "relation").agg(F.count("*").alias("n_targets"), F.sum("c").alias("tension_score"), F.array_sort(F.collect_list(F.struct("at", "target"))).alias("t")).where("n_targets > 1")
    return out.select(F.col("src").alias("source"), "relation", F.transform("t", lambda x: x["target"]).alias("targets"), "n_targets", "tension_score")


def tension_metrics(statements: DataFrame, functional=FUNCTIONAL) -> DataFrame:
    """One row: conflicts, total and average tension (0 when there are none)."""
    c = conflicts(statements, functional).select("tension_score")
    return c.agg(F.count("*").alias("conflict_count"), F.coalesce(F.sum("tension_score"), F.lit(0.0)).alias("total_tension"), F.coalesce(F.avg("tension_score"), F.lit(0.0)).alias("average_tension"))
