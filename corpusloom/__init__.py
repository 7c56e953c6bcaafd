"""Corpus preparation as Spark DataFrame and Structured Streaming jobs."""
