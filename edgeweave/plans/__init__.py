"""Plans of the edge engine."""
