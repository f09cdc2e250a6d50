"""Incremental bars and live scoring with Structured Streaming."""
