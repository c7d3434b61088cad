"""Text files as documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..document import Document
from ..functions.lines import unescaped
from ..model import DIAGNOSTICS, STATEMENTS
from .parse import parse_documents


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of files or folders; backslash escapes of Markdown files are undone."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return rows.withColumn("text", F.when(F.col("doc_id").rlike(r"\.md$"), unescaped("text")).otherwise(F.col("text")))


def parse_files(spark: SparkSession, path: str, mode: str = "auto") -> Document:
    """The Document of files; a path that isn't there gives an E400 row, one that can't be read E401."""
    try:
        return parse_documents(read_texts(spark, path), mode)
    except AnalysisException as e:
        code = "E400" if "PATH_NOT_FOUND" in str(e.getCondition()) else "E401"
        gone = spark.createDataFrame([(path, "error", code, "no such file" if code == "E400" else "unreadable file", None, None, None)], DIAGNOSTICS)
        return Document(spark.createDataFrame([], STATEMENTS), gone, spark.createDataFrame([(path, False)], "doc_id string, is_valid boolean"))
