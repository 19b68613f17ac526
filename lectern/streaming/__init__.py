"""Structured Streaming entry points for incremental scoring."""
