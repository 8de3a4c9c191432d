"""Analytics for short motion and voice recordings, expressed as Spark DataFrame jobs."""
