"""Column expressions and p-value helpers."""
