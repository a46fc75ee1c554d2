"""Column functions: every one takes and returns Spark columns (or column names)."""
