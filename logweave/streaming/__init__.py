"""Structured Streaming: ingest of operations and live state kept by region."""
