"""Structured Streaming forms of the batch time-series features."""
