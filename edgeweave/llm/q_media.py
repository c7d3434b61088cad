"""op2: all texts as progressive JPEG, stored, read back and decoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .media import decode_media, encode_media


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    encode_media(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(folder)
    out = decode_media(spark.read.parquet(folder), tensors=False)
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
