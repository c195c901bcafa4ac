"""Scalar functions: codecs for raw logs, and column expressions."""
