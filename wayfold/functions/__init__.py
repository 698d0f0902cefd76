"""Scalar column functions and fixed dimension tables."""
