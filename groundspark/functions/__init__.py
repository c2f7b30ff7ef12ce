"""Column expressions: text, units, statistics."""
