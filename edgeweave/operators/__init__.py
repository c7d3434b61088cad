"""Operators of the edge engine."""
