"""A Spark-first analytics engine: a small SQL dialect with versioned tables, lowered onto DataFrames."""
