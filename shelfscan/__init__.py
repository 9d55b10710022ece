"""Product-catalog search analytics as Spark DataFrame operators."""
