"""Point-cloud surface analytics as Spark DataFrame operators."""
