"""Column expressions and order statistics."""
