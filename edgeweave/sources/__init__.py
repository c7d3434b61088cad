"""Sources of the edge engine."""
