"""op6: mixing all documents to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing as M
from .common import WORD, table


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.mix_sources(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed_sql(source: str) -> str:
    """CTEs: mixed has the rows of ``source`` with size, source_size, target, taken, passes, rest, position."""
    pick = lambda values: "[" + ", ".join(map(str, values)) + f"][(rank - 1) % {len(values)} + 1]"
    return f"""
  sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM {source}),
  per AS (SELECT *, {pick(M.WEIGHTS)} AS weight, {pick(M.SLOPES)}::DOUBLE AS slope FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM sized GROUP BY source)),
  filled AS (SELECT *, (sum(source_size) OVER () * {M.SHARE_PERCENT} - coalesce(sum(source_size * {M.MOST}) OVER w, 0) * 100)::DOUBLE
      / (100.0::DOUBLE * (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE) AS level
    FROM per WINDOW w AS (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  held AS (SELECT arg_min(level, (source_size::DOUBLE / weight, rank)) FILTER (source_size::DOUBLE * {M.MOST} >= weight * level) AS held FROM filled),
  targets AS (SELECT source, source_size, slope, least(source_size::DOUBLE * {M.MOST}, weight * coalesce(held, 0)) AS target FROM filled, held),
  placed AS (SELECT s.*, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
  passed AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM placed),
  rested AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - passes * source_size - seen)) AS rest, seen::DOUBLE / nullif(target, 0) AS u FROM passed),
  mixed AS (SELECT *, passes * size + rest AS taken,
      CASE WHEN passes * size + rest > 0 THEN least(1.0::DOUBLE, CASE WHEN u <= 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * u / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * u)) END) END AS position FROM rested)"""


OP6_SQL = f"WITH {mixed_sql('documents')} SELECT doc_id, size, source_size, target, taken, position FROM mixed"
