"""Incremental cleaning with Structured Streaming."""
