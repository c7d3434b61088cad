"""op4: license notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import license_matches


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))
