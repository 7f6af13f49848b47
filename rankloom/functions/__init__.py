"""Column-level building blocks (no shuffles, all plain Spark expressions)."""
