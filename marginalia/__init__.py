"""Document-annotation analytics as composable Spark DataFrame operators."""
