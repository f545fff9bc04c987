"""Table-level operators, grouped by subject."""
