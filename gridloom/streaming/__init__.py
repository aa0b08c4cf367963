"""Structured Streaming pipelines over event logs and keyed records."""
