"""Incremental indexing and live metrics by Structured Streaming."""
