"""Compare and patch documents: statements pair by key and rank, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DiffError
from ..functions.values import canonical, pairs, source_id, target_id
from ..storage import stored

KEY = ("source_namespace", "source", "target_namespace", "target", "arrow")


def _side(statements: DataFrame, p: str) -> DataFrame:
    text = canonical()
    rows = statements.select(*[F.col(k).alias(f"{p}_{k}") for k in KEY], F.col("stmt_idx").alias(f"{p}_idx"), text.alias(f"{p}_text"), F.col("path_type").alias(f"{p}_path"), pairs().alias(f"{p}_pairs"), F.concat(source_id(), F.lit(" -> "), target_id()).alias(f"{p}_label"))
    rank = F.row_number().over(Window.partitionBy(*[f"{p}_{k}" for k in KEY]).orderBy(f"{p}_text", f"{p}_idx"))
    return rows.withColumn(f"{p}_rank", rank)


def changes(a: Column, b: Column, path_a: Column, path_b: Column) -> Column:
    """(field, old_value, new_value) of the modifiers that differ, by key; then the path type."""
    get = lambda m, k: F.get(F.transform(F.filter(m, lambda p: p["key"] == k), lambda p: p["value"]), F.lit(0))
    keys = F.array_sort(F.array_distinct(F.concat(F.transform(a, lambda p: p["key"]), F.transform(b, lambda p: p["key"]))))
    differ = F.filter(F.transform(keys, lambda k: F.struct(k.alias("field"), get(a, k).alias("old_value"), get(b, k).alias("new_value"))), lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    path = F.when(~path_a.eqNullSafe(path_b), F.array(F.struct(F.lit("path_type").alias("field"), path_a.alias("old_value"), path_b.alias("new_value"))))
    return F.concat(differ, F.coalesce(path, F.filter(differ, lambda c: F.lit(False))))


def diff(a: DataFrame, b: DataFrame, keep_unchanged: bool = False) -> DataFrame:
    """op (add, remove, modify), key, index_a, index_b, statement_a, statement_b, modifier_changes."""
    x, y = _side(a, "a"), _side(b, "b")
    on = reduce(lambda p, q: p & q, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in KEY]) & (F.col("a_rank") == F.col("b_rank"))
    both = x.join(y, on, "full_outer")
    same = (F.col("a_text") == F.col("b_text")) & F.col("a_path").eqNullSafe(F.col("b_path"))
    op = F.when(F.col("a_rank").isNull(), "add").when(F.col("b_rank").isNull(), "remove").when(same, "unchanged").otherwise("modify")
    rows = both.select(
        op.alias("op"), F.coalesce("a_label", "b_label").alias("key"), F.col("a_idx").alias("index_a"), F.col("b_idx").alias("index_b"), F.col("a_text").alias("statement_a"), F.col("b_text").alias("statement_b"),
        F.when(op == "modify", changes(F.col("a_pairs"), F.col("b_pairs"), F.col("a_path"), F.col("b_path"))).alias("modifier_changes"),
    )
    return rows if keep_unchanged else rows.where("op <> 'unchanged'")


def diff_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: added, removed, modified, unchanged, total_a, total_b."""
    n = lambda *ops: F.count(F.when(F.col("op").isin(*ops), 1))
    return diff(a, b, keep_unchanged=True).agg(n("add").alias("added"), n("remove").alias("removed"), n("modify").alias("modified"), n("unchanged").alias("unchanged"), n("remove", "modify", "unchanged").alias("total_a"), n("add", "modify", "unchanged").alias("total_b"))


def diff_text(entries: DataFrame) -> DataFrame:
    """One line an entry: + added, - removed, ~ modified with its changes."""
    shown = F.array_join(F.transform("modifier_changes", lambda c: F.concat(c["field"], F.lit(": "), F.coalesce(c["old_value"], F.lit("None")), F.lit(" -> "), F.coalesce(c["new_value"], F.lit("None")))), "; ")
    line = F.when(F.col("op") == "add", F.concat(F.lit("+ "), "statement_b")).when(F.col("op") == "remove", F.concat(F.lit("- "), "statement_a")).otherwise(F.concat(F.lit("~ "), "key", F.lit(" "), shown))
    return entries.select("key", "index_a", "index_b", line.alias("line"))


#: Order keys of a block: running numbers are windows within blocks plus what lies before the block.
BLOCK_BITS = 16


def _blocks(rows: DataFrame, by: str, what: Column) -> DataFrame:
    """``rows`` with __block (of ``by``) and __before: the sum of ``what`` over all earlier blocks."""
    block = F.shiftright(F.col(by).cast("long"), BLOCK_BITS)
    sums = rows.groupBy(block.alias("__block")).agg(F.sum(what).alias("__sum"))
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    return rows.withColumn("__block", block).join(sums, "__block")


def _numbered(rows: DataFrame, by: str, *then: str) -> DataFrame:
    """``rows`` with ``at``: their number from 0 in the order of ``by`` and ``then``."""
    inside = Window.partitionBy("__block").orderBy(by, *then)
    return _blocks(rows, by, F.lit(1)).withColumn("at", F.col("__before") + F.row_number().over(inside) - 1).drop("__block", "__before")


def _running(rows: DataFrame, by: str, what: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``what`` over all rows whose ``by`` is not greater."""
    inside = Window.partitionBy("__block").orderBy(by)
    return _blocks(rows, by, F.col(what)).withColumn(name, F.col("__before") + F.sum(what).over(inside)).drop("__block", "__before")


def patch(a: DataFrame, entries: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with the entries applied; ``b`` is where added and changed statements are taken from.

    One document. Statements are found by index and text, so an index may have
    gaps and repeat. An addition comes after as many survivors as ``b`` has
    statements, other than additions, with its index or a smaller one. Raises
    E951 if an entry meets another text than it expects.
    """
    body = [c for c in b.columns if c not in ("doc_id", "stmt_idx")]
    text = F.xxhash64(canonical())
    e = stored(entries.select("op", "index_a", F.xxhash64("statement_a").alias("text_a"), "index_b", F.xxhash64("statement_b").alias("text_b")))
    same = lambda i, t, by: F.row_number().over(Window.partitionBy(i, t).orderBy(by))
    taken = e.where("op in ('remove', 'modify')").withColumn("nth_a", same("index_a", "text_a", F.col("index_b").asc_nulls_last()))
    old = a.withColumn("__text", text).withColumn("__nth", same("stmt_idx", "__text", "path_type"))
    found = (F.col("stmt_idx") == F.col("index_a")) & (F.col("__text") == F.col("text_a")) & (F.col("__nth") == F.col("nth_a"))
    met = stored(old.select("stmt_idx", "__text", "__nth").join(taken, found, "left").select("stmt_idx", "__text", "__nth", "op", "index_b", "text_b"))
    if met.where("op is not null").count() < taken.count():
        raise DiffError("E951")
    survivors = met.where("op is null or op = 'modify'")
    n = survivors.count()

    added = e.where("op = 'add'").select("index_b", "text_b")
    per = b.select(F.col("stmt_idx").alias("index_b"), F.lit(1).alias("others"), F.lit(0).alias("adds"))
    per = per.unionByName(added.select("index_b", F.lit(-1).alias("others"), F.lit(1).alias("adds"))).groupBy("index_b").agg(F.sum("others").alias("others"), F.sum("adds").alias("adds"))
    after = _running(per, "index_b", "others", "after").where("adds > 0").select(F.col("index_b").alias("__b"), F.least("after", F.lit(n)).alias("after"), "adds")
    after = stored(after)
    new = _numbered(added, "index_b", "text_b").join(after.drop("adds"), F.col("index_b") == F.col("__b")).select("index_b", "text_b", (F.col("at") + F.col("after")).alias("at"))
    kept = _numbered(survivors, "stmt_idx", "__text", "__nth").select(F.col("at").alias("k"), F.lit(0).cast("long").alias("adds"), *survivors.columns)
    kept = kept.unionByName(after.select(F.col("after").alias("k"), "adds"), allowMissingColumns=True)
    kept = stored(_running(kept, "k", "adds", "ahead").where("stmt_idx is not null").withColumn("at", F.col("k") + F.col("ahead")))

    fresh = b.withColumn("__text", text).withColumn("__nth", same("stmt_idx", "__text", "path_type")).where("__nth = 1")
    placed = new.unionByName(kept.where("op = 'modify'").select("index_b", "text_b", "at"))
    placed = fresh.join(placed, (F.col("stmt_idx") == F.col("index_b")) & (F.col("__text") == F.col("text_b"))).select("at", *body)
    as_is = kept.where("op is null").select(F.col("stmt_idx").alias("k_idx"), F.col("__text").alias("k_text"), F.col("__nth").alias("k_nth"), "at")
    as_is = old.join(as_is, (F.col("stmt_idx") == F.col("k_idx")) & (F.col("__text") == F.col("k_text")) & (F.col("__nth") == F.col("k_nth"))).select("at", *body)
    out = as_is.unionByName(placed).withColumn("stmt_idx", F.col("at").cast("int"))
    return out.withColumn("doc_id", F.lit("0")).select("doc_id", "stmt_idx", *body)
