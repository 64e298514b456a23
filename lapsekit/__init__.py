"""Customer-churn analytics expressed as Spark DataFrame and ML jobs."""
