"""Codes and exceptions."""

from __future__ import annotations

#: The codes that operators raise or report.
CODES = {
    "E001": "syntax error",
    "E002": "invalid value",
    "E003": "lines that look like broken statements",
    "E100": "invalid anchor",
    "E105": "invalid modifier value",
    "E107": "invalid rule",
    "E108": "invalid anchor type",
    "E111": "contradictory modifiers",
    "E112": "invalid date",
    "E113": "causal path without a cause",
    "E200": "unexpected JSON shape",
    "E201": "invalid JSON",
    "E300": "the document is invalid",
    "E302": "no such node",
    "E400": "no such file",
    "E401": "unreadable file",
    "E450": "unknown operator",
    "E451": "no such segment",
    "E452": "index out of range",
    "E600": "schema syntax",
    "E601": "schema: structure",
    "E603": "schema: value",
    "E900": "invalid half-life",
    "E951": "patch does not apply",
    "E960": "unreadable source",
    "E962": "statement spans too many lines",
    "W002": "unusual anchor name",
    "W003": "low confidence",
    "W004": "no modifiers",
    "W006": "duplicate statement",
}


class EdgeError(Exception):
    """An error with a code."""

    def __init__(self, code: str, message: str = ""):
        self.code = code
        super().__init__(f"[{code}] {message or CODES.get(code, '')}")


class ParseError(EdgeError): ...


class ValidationError(EdgeError): ...


class SerializationError(EdgeError): ...


class GraphError(EdgeError): ...


class QueryError(EdgeError): ...


class FileError(EdgeError): ...


class SchemaError(EdgeError): ...


class DecayError(EdgeError): ...


class DiffError(EdgeError): ...


class ReaderError(EdgeError): ...
