"""Appending statements to a text log, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical
from ..model import FIELDS
from ..operators.validate import is_valid_statement


def stamped(statements: DataFrame, namespace: str | None = None, timestamp: bool = True) -> DataFrame:
    """Anchors without a namespace get one; statements without a timestamp get the time, in UTC, to the second."""
    out = statements
    if namespace:
        out = out.withColumns({f"{p}_namespace": F.coalesce(F.nullif(f"{p}_namespace", F.lit("")), F.lit(namespace)) for p in ("source", "target")})
    if timestamp:
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        m = F.col("modifiers")
        out = out.withColumns({"modifiers": F.struct(*[(F.coalesce(m[f], now) if f == "timestamp" else m[f]).alias(f) for f in FIELDS]), "has_modifiers": F.lit(True)})
    return out


def log_lines(statements: DataFrame, section: str | None = None) -> DataFrame:
    """value: the statements' lines in order; a section heading first, as a comment."""
    rows = statements.select(F.struct("doc_id", "stmt_idx").alias("k"), canonical().alias("value"))
    if section:
        head = statements.sparkSession.range(1).select(F.lit(None).cast(rows.schema["k"].dataType).alias("k"), F.lit(f"# --- {section} ---").alias("value"))
        rows = head.unionByName(rows)
    return rows.orderBy(F.col("k").asc_nulls_first()).select("value")


def append(statements: DataFrame, path: str, namespace: str | None = None, timestamp: bool = True, validate: bool = False, section: str | None = None) -> None:
    """Appends to the log in folder ``path``; with ``validate`` only valid statements."""
    out = stamped(statements.where(is_valid_statement()) if validate else statements, namespace, timestamp)
    log_lines(out, section).write.mode("append").text(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str, namespace: str | None = None, timestamp: bool = True, then: Callable[[DataFrame], None] | None = None):
    """Starts a query that appends every micro-batch."""

    def write(batch: DataFrame, _: int) -> None:
        append(batch, path, namespace, timestamp)
        if then:
            then(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def comment(text: str) -> Column:
    return F.lit(f"# {text}")
