"""Wildfire detection and incident analytics expressed as Spark DataFrame, SQL and Structured Streaming pipelines."""
