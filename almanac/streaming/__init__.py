"""Structured Streaming versions of the incremental news jobs."""
