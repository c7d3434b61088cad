"""Annotated, directed relations as Spark DataFrames."""

__version__ = "0.1.0"
