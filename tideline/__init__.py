"""Customer value and churn analytics as Spark DataFrame operators."""
