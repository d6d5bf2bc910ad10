"""tracklake: vessel-track analytics as Spark DataFrame operators."""
