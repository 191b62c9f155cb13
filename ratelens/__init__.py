"""Ratelens: rate-observation analytics expressed as Spark DataFrame jobs."""
