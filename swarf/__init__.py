"""Process and sensor analytics as Spark DataFrame operators."""
