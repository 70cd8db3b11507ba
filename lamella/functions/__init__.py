"""Column-level formulas and casts."""
