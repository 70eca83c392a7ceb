"""Scalar and vector column functions."""
