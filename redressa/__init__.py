"""Complaint-ticket analytics as Spark DataFrame and Structured Streaming jobs."""
