"""Marketing-path analytics as Spark DataFrame operators."""
