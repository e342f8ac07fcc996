"""lodestack: a Spark-first engine for structured document knowledge."""
