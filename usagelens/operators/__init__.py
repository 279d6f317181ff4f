"""Generic DataFrame operators with column parameters (keys, users, measures, dimensions)."""
