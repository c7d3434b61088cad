"""A document set: statements, diagnostics and documents as DataFrames, with the reference operations as methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Document:
    statements: DataFrame
    diagnostics: DataFrame | None = None
    documents: DataFrame | None = None

    def find(self, **where) -> DataFrame:
        from .operators import query

        return query.find(self.statements, **where)

    def find_all(self, **where) -> DataFrame:
        from .operators import query

        return query.find_all(self.statements, **where)

    def filter(self, **where) -> Document:
        """The matching statements; validity is kept, diagnostics are not."""
        return Document(self.find_all(**where), None, self.documents)

    def select(self, *fields: str) -> DataFrame:
        from .operators import query

        return query.select(self.statements, *fields)

    def pointer(self, path: str) -> DataFrame:
        from .operators import query

        return query.pointer(self.statements, path)

    def __getitem__(self, key) -> DataFrame:
        from .operators import query

        return query.item(self.statements, key)

    def to_text(self) -> DataFrame:
        from .sinks.text import canonical_text

        return canonical_text(self.statements)

    def is_valid(self) -> DataFrame:
        return self.documents.select("doc_id", "is_valid")

    def require_valid(self) -> None:
        """Raises if a document of the set is invalid; one row is looked at."""
        from .errors import GraphError

        if self.documents is not None and self.documents.where(~F.col("is_valid")).limit(1).count():
            raise GraphError("E300")
