"""Column-level helpers; each takes and returns Spark columns."""
