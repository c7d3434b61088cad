"""Functions of the edge engine."""
