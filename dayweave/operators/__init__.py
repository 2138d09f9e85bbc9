"""DataFrame operators, grouped by theme."""
