"""Document analytics as Spark DataFrame transforms."""
