"""Streaming forms of scoring and profiling."""
