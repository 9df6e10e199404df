"""Incremental variants as Structured Streaming queries."""
