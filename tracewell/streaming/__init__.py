"""Structured Streaming forms of the sequence checks."""
