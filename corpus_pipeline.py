"""The corpus pipeline: quality rules, near and exact dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
Null, empty and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeweave.llm.common import materialise, table
from edgeweave.llm.mixing import mixed_documents
from edgeweave.llm.nearcopies import without_near_copies
from edgeweave.llm.packing import packed
from edgeweave.llm.quality import quality_filter
from edgeweave.llm.suffixes import suffix_deduplicated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a risk-controlled cutoff rejects go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash blocks, checked on five-word shingles: similarity 0.8 or more) the document with the smallest id stays."""
    return without_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings are cut out."""
    return suffix_deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources meet their targets."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix),
    ("pack_sequences", pack),
]

#: SQL can't express fingerprints' components and tokenization; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
