"""Game-log analytics as Spark DataFrame jobs."""
