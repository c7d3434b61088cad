"""Reading statement logs as streams.

``read_stream`` follows a folder of files; ``tail`` follows appended lines of
one file through a Python data source with byte offsets. Lines are merged to
statements per micro-batch source row; a statement over more than
``MAX_LINES`` lines is an error (E962) or, if errors are skipped, dropped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..document import Document
from ..errors import ReaderError
from ..functions import lines as L
from ..operators.query import matches
from ..sources.parse import parse_documents

MAX_LINES = 20


def statement_lines(texts: DataFrame) -> DataFrame:
    """doc_id, line, text, n_lines: one row a merged statement of ``texts`` (doc_id, text); comments and blanks are left out."""
    rows = texts.select("doc_id", F.posexplode(L.merged("text")).alias("k", "m"), F.size(F.split("text", "\n", -1)).alias("t"), L.merged("text").alias("all"))
    nxt = F.coalesce(F.get("all", F.col("k") + 1)["line"], F.col("t") + 1)
    rows = rows.select("doc_id", F.col("m.line").alias("line"), F.col("m.text").alias("text"), (nxt - F.col("m.line")).alias("n_lines"))
    return rows.where(~L.line_type("text").isin("empty", "comment"))


def line_statements(texts: DataFrame, on_error: str = "raise", first_hop_only: bool = True, **where) -> DataFrame:
    """Statements of ``texts`` read line by line: a bad line costs only itself.

    ``on_error``: raise (E001/E962 as a runtime error), skip, or report (use ``line_errors``).
    """
    rows = statement_lines(texts)
    keyed = rows.select(F.to_json(F.struct("doc_id", "line")).alias("doc_id"), F.when(F.col("n_lines") <= MAX_LINES + 1, F.col("text")).otherwise("[").alias("text"))
    if on_error == "raise":
        from ..sources.parse import is_valid_text

        ok = is_valid_text("text")
        keyed = keyed.withColumn("text", F.when(ok, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("E001/E962: "), F.col("text"))).cast("string")))
    doc: Document = parse_documents(keyed, "strict", merge=False, first_hop_only=first_hop_only)
    out = doc.statements.withColumn("__k", F.from_json("doc_id", "doc_id string, line int")).withColumns({"doc_id": F.col("__k.doc_id"), "line": F.col("__k.line")}).drop("__k")
    return out.where(matches(**where)) if where else out


def line_errors(texts: DataFrame) -> DataFrame:
    """doc_id, line, code, text of the lines that give no statement."""
    from ..sources.parse import is_valid_text

    bad = statement_lines(texts).withColumn("code", F.when(F.col("n_lines") > MAX_LINES + 1, "E962").when(~is_valid_text("text"), "E001"))
    return bad.where("code is not null").select("doc_id", "line", "code", "text")


def stats(texts: DataFrame) -> DataFrame:
    """One row: lines_processed, statements_yielded, errors_skipped, comments_seen, blank_lines."""
    kinds = texts.select(F.explode(F.split("text", "\n", -1)).alias("x")).select(L.line_type("x").alias("k"))
    n = lambda c: F.count(F.when(c, 1))
    seen = kinds.agg(F.count("*").alias("lines_processed"), n(F.col("k") == "comment").alias("comments_seen"), n(F.col("k") == "empty").alias("blank_lines"))
    found = line_statements(texts, on_error="skip").agg(F.count("*").alias("statements_yielded"))
    bad = line_errors(texts).agg(F.count("*").alias("errors_skipped"))
    return seen.join(F.broadcast(found)).join(F.broadcast(bad))  # one row each


def read_stream(spark: SparkSession, path: str, on_error: str = "skip", **where) -> DataFrame:
    """A stream of statements of the files that come into folder ``path``, each file read whole."""
    if not path:
        raise ReaderError("E960")
    texts = spark.readStream.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return line_statements(texts, on_error, **where)


class _TailReader(SimpleDataSourceStreamReader):
    """Complete lines of a growing file, from a byte offset on. Replays give the same lines."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _lines(self, begin: int, end: int | None) -> tuple[list[tuple[str, int]], int]:
        with open(self.path, "rb") as f:
            f.seek(begin)
            data = f.read() if end is None else f.read(end - begin)
        whole = data[: data.rfind(b"\n") + 1]
        out, at = [], begin
        for raw in whole.splitlines(keepends=True):
            out.append((raw.decode("utf-8", "replace").rstrip("\r\n"), at))
            at += len(raw)
        return out, begin + len(whole)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = self._lines(start["at"], None) if os.path.exists(self.path) else ([], start["at"])
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(start["at"], end["at"])[0])


class TailSource(DataSource):
    """``spark.readStream.format("edge_tail").option("path", file)``: value, byte_offset."""

    @classmethod
    def name(cls) -> str:
        return "edge_tail"

    def schema(self) -> str:
        return "value string, byte_offset long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TailReader(self.options["path"])


def tail(spark: SparkSession, path: str, on_error: str = "skip", **where) -> DataFrame:
    """A stream of the statements appended to one file; every statement on its line."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("edge_tail").option("path", path).load()
    return line_statements(lines.select(F.col("byte_offset").cast("string").alias("doc_id"), F.col("value").alias("text")), on_error, **where)


def windowed_counts(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour", by: Column | None = None) -> DataFrame:
    """Statements per event-time window of their timestamp, late ones dropped after ``delay``."""
    from ..functions.values import instant

    dated = stream.withColumns({"event_time": instant("modifiers.timestamp"), "key": by if by is not None else F.col("modifiers.rule")}).where("event_time is not null")
    return dated.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "key").agg(F.count("*").alias("n"), F.avg("modifiers.confidence").alias("mean_confidence"))
