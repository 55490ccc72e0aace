"""Risk-adjusted outcome analytics as Spark DataFrame operators."""
