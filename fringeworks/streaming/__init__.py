"""Incremental imaging with Structured Streaming."""
