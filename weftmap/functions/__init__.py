"""Column expressions and the p-value kernel."""
