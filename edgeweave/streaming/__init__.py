"""Streaming of the edge engine."""
