"""op10: repeated 100-byte strings of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .suffixes import repeated_suffixes


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
