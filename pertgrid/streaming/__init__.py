"""Incremental pooling with Structured Streaming."""
