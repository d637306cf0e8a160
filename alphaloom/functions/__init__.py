"""Column-level building blocks (no UDFs)."""
