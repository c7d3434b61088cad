"""op8: token ids of all documents in Simple-8b files, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .common import shared_dir, table
from .tokenfile import read_token_files, write_token_files


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
