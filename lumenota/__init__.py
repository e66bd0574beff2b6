"""Invoice quality analytics as Spark DataFrame operators."""
