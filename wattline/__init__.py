"""Electric-grid analytics as Spark DataFrame jobs."""
