"""Column expressions: no DataFrames, no state."""
