"""Incremental versions of the trend and merge queries on Structured Streaming."""
