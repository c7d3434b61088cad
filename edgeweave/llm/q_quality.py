"""op5: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality as Q
from .common import WORD, table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def features_sql(source: str) -> str:
    """CTE body: ``source`` (doc_id, text, lang) with the counts; ``row`` numbers the rows."""
    w = WORD.replace("'", "''")
    return f"""
  base AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, lang FROM {source}),
  split AS (SELECT *, regexp_extract_all(text, '{w}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{w}')) AS lines FROM base),
  windows AS (SELECT row, i AS p, array_to_string(words[i + 1:i + 5], ' ') AS s FROM (SELECT row, words, unnest(range(0, greatest(0, len(words)::BIGINT - 4))) AS i FROM split)),
  twice AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY row, s) AS n FROM windows) WHERE n > 1),
  covered AS (SELECT row, sum(least(5, p - coalesce(before, -5)))::BIGINT AS n FROM (SELECT row, p, lag(p) OVER (PARTITION BY row ORDER BY p) AS before FROM twice) GROUP BY row),
  features AS (
    SELECT s.row, s.doc_id, s.lang, s.text, len(words)::BIGINT AS n_words,
      length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM split s LEFT JOIN covered c ON s.row = c.row),
  judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM features)"""


def _ratio_sql(rule: str) -> str:
    over, under = Q.RULES[rule][0].split(" / ")
    return f"({over}::DOUBLE / greatest({under}, 1)::DOUBLE)"


def verdict_sql() -> str:
    """CTEs after judged: strata with their last step, and verdict (judged with kept)."""
    steps = []
    for rule, (_, grid) in Q.RULES.items():
        numbers = [k for k, (r, _) in enumerate(Q.STEPS) if r == rule]
        steps.append(f"{numbers}[len(list_filter({grid}::DOUBLE[], lambda c: {_ratio_sql(rule)} <= c)) + 1]")
    lost = ", ".join(f"count(*) FILTER (first <= {k}) AS k_{k}" for k in range(len(Q.STEPS)))
    last = ", ".join(f"CASE WHEN k_{k} <= k_max THEN {k} END" for k in range(len(Q.STEPS)))
    a = Q.MAX_FALSE_REJECTION
    return f"""
  stepped AS (SELECT *, least({', '.join(steps)}) AS first FROM judged),
  good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
  one AS (SELECT lang AS stratum, text, min(first) AS first FROM stepped WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY lang, text),
  counted AS (SELECT stratum, count(*) AS n, {lost} FROM one GROUP BY stratum),
  tail AS (SELECT stratum, k, sum(exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * ln({a}::DOUBLE) + (n - k) * ln(1 - {a}::DOUBLE))) OVER (PARTITION BY stratum ORDER BY k) AS p
    FROM (SELECT stratum, n, unnest(range(0, greatest(1, floor(n * {a})::BIGINT) + 1)) AS k FROM counted)),
  most AS (SELECT stratum, coalesce(max(k) FILTER (p <= {Q.ERROR} / (SELECT count(*) FROM counted)), -1) AS k_max FROM tail GROUP BY stratum),
  chosen AS (SELECT c.stratum, greatest({last}) AS step FROM counted c JOIN most m ON c.stratum IS NOT DISTINCT FROM m.stratum),
  verdict AS (SELECT j.*, NOT base_failed AND NOT coalesce(first <= step, FALSE) AS kept FROM stepped j LEFT JOIN chosen c ON j.lang IS NOT DISTINCT FROM c.stratum)"""


OP5_SQL = f"""WITH {features_sql('documents')}, {verdict_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"""
