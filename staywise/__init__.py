"""Customer-churn analytics and scoring expressed as Spark DataFrame jobs."""
