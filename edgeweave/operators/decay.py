"""Confidence that decays with age."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DecayError
from ..functions.values import instant

HALF_LIFE_DAYS = 30.0
MIN_THRESHOLD = 0.01


def age_days(reference: str | datetime | None = None, timestamp: str = "modifiers.timestamp") -> Column:
    """Days from the statement's timestamp to the reference (now, if none is given); negative for the future."""
    ref = F.current_timestamp() if reference is None else F.to_timestamp(F.lit(str(reference)))
    return (F.unix_micros(ref) - F.unix_micros(instant(timestamp))) / 86_400_000_000


def effective_confidence(half_life_days: float = HALF_LIFE_DAYS, reference: str | datetime | None = None) -> Column:
    """confidence * 0.5 ^ (age / half-life); undated or future statements keep theirs, those without stay null."""
    if half_life_days <= 0:
        raise DecayError("E900", str(half_life_days))
    c, age = F.col("modifiers.confidence"), age_days(reference)
    decayed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c * F.pow(F.lit(0.5), age / half_life_days)))
    return F.when(age > 0, decayed).otherwise(c)


def decay_rows(statements: DataFrame, half_life_days: float = HALF_LIFE_DAYS, reference=None, min_threshold: float = MIN_THRESHOLD) -> DataFrame:
    """original, effective (below the threshold: 0), age_days and decay_ratio of the statements with a confidence."""
    eff = effective_confidence(half_life_days, reference)
    rows = statements.where(F.col("modifiers.confidence").isNotNull()).withColumns({"original": F.col("modifiers.confidence"), "effective": F.when(eff < min_threshold, 0.0).otherwise(eff), "age_days": age_days(reference)})
    return rows.withColumn("decay_ratio", F.when(F.col("original") > 0, F.col("effective") / F.col("original")).otherwise(1.0))


def decay_summary(statements: DataFrame, half_life_days: float = HALF_LIFE_DAYS, reference=None, min_threshold: float = MIN_THRESHOLD) -> DataFrame:
    """One row: total, with_timestamp, decayed, and mean, median, min, max and count of the effective values."""
    eff = effective_confidence(half_life_days, reference)
    c = F.col("modifiers.confidence")
    e = F.when(c.isNotNull(), F.when(eff < min_threshold, 0.0).otherwise(eff))
    return statements.select(c.alias("c"), age_days(reference).alias("a"), e.alias("e")).agg(
        F.count("*").alias("total"),
        F.count("a").alias("with_timestamp"),
        F.coalesce(F.sum(((F.col("e") < F.col("c"))).cast("long")), F.lit(0)).alias("decayed"),
        F.avg("e").alias("mean"),
        F.median("e").alias("median"),
        F.min("e").alias("min"),
        F.max("e").alias("max"),
        F.count("e").alias("count"),
    )


def filter_by_confidence(statements: DataFrame, minimum: float = 0.5, half_life_days: float = HALF_LIFE_DAYS, reference=None) -> DataFrame:
    """Statements whose decayed confidence reaches the minimum; those without one stay."""
    eff = effective_confidence(half_life_days, reference)
    return statements.where(eff.isNull() | (eff >= minimum))
