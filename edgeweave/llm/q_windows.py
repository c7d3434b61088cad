"""op9: repeated 20-word windows of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table
from .windows import WINDOW, repeated_windows


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = f"""WITH base AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, encode(text)) AS row, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
  windows AS (SELECT row, i AS p, sha256(array_to_string(words[i + 1:i + {WINDOW}], ' ')) AS s FROM (SELECT row, words, unnest(range(0, greatest(0, len(words)::BIGINT - {WINDOW - 1}))) AS i FROM base)),
  again AS (SELECT row, p FROM (SELECT row, p, row_number() OVER (PARTITION BY s ORDER BY row, p) AS k FROM windows) WHERE k > 1),
  gone AS (SELECT DISTINCT row, w FROM (SELECT row, unnest(range(p, p + {WINDOW})) AS w FROM again)),
  kept AS (SELECT b.row, string_agg(b.word, ' ' ORDER BY b.w) AS text, count(*) AS n FROM (SELECT row, unnest(words) AS word, unnest(range(0, len(words)::BIGINT)) AS w FROM base) b ANTI JOIN gone g ON b.row = g.row AND b.w = g.w GROUP BY b.row)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM base LEFT JOIN kept USING (row)"""
