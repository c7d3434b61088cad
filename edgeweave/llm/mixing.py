"""Mixing sources to target weights along a time-varying curriculum.

Sizes are word counts. Sources in code-point order (null last) weigh
``WEIGHTS`` in turn and share ``share`` of all words; no source gives more than
``most`` times its words, and what it can't give goes to the others by weight.
A source's stream is its documents in the order of the MD5 of their ids, again
and again; the mix takes the first ``floor(target)`` words of that stream.

Curriculum: source s has the weight schedule w_s(t) = 1 + k_s (2t - 1) over
training time t in [0, 1]. Its integral t + k_s (t^2 - t) times the target is
the source's cumulative demand for words; the position of a use of a document is
the time at which the demand reaches the words before it (those of all earlier
passes included), the inverse in closed form. So a source that is used twice
lasts the whole training. The rows are range-sorted by position; a document that
the mix doesn't take has none.

A running sum over a source that holds a third of all rows would be one task.
Hence the stream is cut by leading MD5 digits into blocks: block totals are
summed first, then rows within their block. The result does not depend on the
number of blocks.

DataFrame functions only. A null text has size 0 and takes 0 words. A null
source is a source; a null doc_id counts as the empty string in the order.
Rows that agree in id and size are alike, so their order does not matter. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, shuffle_partitions

WEIGHTS = (3, 1, 2)
#: k_s of the sources in turn: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)
SHARE_PERCENT = 150
MOST = 2


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size, weight, slope, target. ``sizes``: source, size (any number of rows a source)."""
    # one row a source from here on
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumns({"weight": _cycle(weights, F.col("rank")).cast("long"), "slope": _cycle(slopes, F.col("rank")).cast("double")})
    # filling up: with the sources in the order of cap / weight, those before the first that keeps its share are at their cap
    order = Window.orderBy((F.col("source_size").cast("double") / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumns(
        {
            "caps": F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)),
            "used": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "all_size": F.sum("source_size").over(everything),
            "all_weight": F.sum("weight").over(everything),
        }
    )
    level = (F.col("all_size") * share_percent - F.col("caps") * 100).cast("double") / (100.0 * (F.col("all_weight") - F.col("used")))
    per = per.withColumn("level", level)
    # the lowest level at which a source stays below its cap is the one that holds
    per = per.withColumn("open", F.col("source_size").cast("double") * most >= F.col("weight") * F.col("level"))
    per = per.withColumn("held", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("source_size").cast("double") * most, F.col("weight") * F.coalesce("held", F.lit(0.0)))
    return per.select("source", "source_size", "weight", "slope", target.alias("target"))


def demand_inverse(share: Column, slope: Column) -> Column:
    """The t in [0, 1] at which t + slope (t^2 - t) = share."""
    return F.when(share <= 0, F.lit(0.0)).otherwise(2.0 * share / ((1.0 - slope) + F.sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * share)))


def _placed(docs: DataFrame, columns: list[str], text: str = "text", **how) -> DataFrame:
    """__doc (``columns`` of the row), doc_id, size, source_size, target, taken, passes, rest, __at (words of its source before it) and slope."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select(F.struct(*columns).alias("__doc"), "doc_id", F.col("source").alias("__from"), size.alias("size"), order.alias("__order"))
    slim = docs.select("source", size.alias("size"), F.conv(F.substring(order, 1, 4), 16, 10).cast("int").alias("__hex"))
    blocks = min(65536, max(64, 1 << (2 * shuffle_partitions(spark)).bit_length()))
    block = F.floor(F.col("__hex") / (65536 // blocks)).cast("int")
    # materialised: one row a block and source
    totals = materialise(slim.withColumn("__block", block).groupBy("source", "__block").agg(F.sum("size").alias("size")), "blocks")
    targets = materialise(source_targets(totals, **how).coalesce(1), "targets")
    run = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "__block", F.coalesce(F.sum("size").over(run), F.lit(0)).alias("__before"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("__source"), F.col("__block").alias("__b"), "__before", "source_size", "target", "slope")
    inside = Window.partitionBy("__from", "__block").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("__block", F.floor(F.conv(F.substring("__order", 1, 4), 16, 10).cast("int") / (65536 // blocks)).cast("int"))
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(materialise(starts, "starts"), F.col("__from").eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__b")))
    rows = rows.withColumn("__at", F.col("__before") + F.col("__in"))
    whole = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"passes": passes, "__left": whole - passes * F.col("source_size")})
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - F.col("__at"))).cast("long")
    rows = rows.withColumn("rest", rest).withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))
    return rows.select("__doc", "doc_id", "size", "source_size", "target", "taken", "passes", "rest", "__at", "slope")


def _position(use: Column) -> Column:
    """The time of the ``use``-th use (from 0) of a row of ``_placed``."""
    before = (use * F.col("source_size") + F.col("__at")).cast("double")
    return F.least(F.lit(1.0), demand_inverse(before / F.col("target"), F.col("slope")))


def mix_sources(docs: DataFrame, text: str = "text", columns: list[str] | None = None, **how) -> DataFrame:
    """``columns`` of ``docs`` (all) with size, source_size, target, taken, passes, rest and position, range-sorted by position.

    ``passes`` whole uses and then ``rest`` words of one more are taken;
    ``position`` is that of the first use, null if nothing is taken. Columns of
    ``docs`` that have one of these names are replaced.
    """
    added = ["size", "source_size", "target", "taken", "passes", "rest", "position"]
    columns = [c for c in columns or docs.columns if c not in added]
    rows = _placed(docs, columns, text, **how).withColumn("position", F.when(F.col("taken") > 0, _position(F.lit(0)))).orderBy("position", "doc_id")
    return rows.select(*[F.col("__doc")[c].alias(c) for c in columns], *added)


def mixed_documents(docs: DataFrame, position: str | None = None, **how) -> DataFrame:
    """The documents of the mix, each as often as it is used, in the order of the uses' positions; a use of at least half its words counts.

    With the columns of ``docs`` and, if it is named, a column ``position``.
    """
    uses = F.col("passes") + F.when((F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size")), F.lit(1)).otherwise(F.lit(0))
    rows = _placed(docs, docs.columns, **how).withColumn("__uses", uses.cast("int")).where("__uses > 0 and size > 0")
    rows = rows.withColumn("__use", F.explode(F.sequence(F.lit(0), F.col("__uses") - 1))).withColumn("__position", _position(F.col("__use")))
    rows = rows.orderBy("__position", "doc_id", "__use")
    return rows.select("__doc.*", *([F.col("__position").alias(position)] if position else []))
