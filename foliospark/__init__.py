"""Document-corpus analytics as Spark DataFrame, SQL and streaming jobs."""
