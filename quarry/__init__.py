"""Quarry: knowledge-base and training-data analytics as plain Spark DataFrame jobs."""
