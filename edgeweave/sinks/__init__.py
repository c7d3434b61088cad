"""Sinks of the edge engine."""
