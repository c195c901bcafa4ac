"""Operators for preparing text corpora for language-model training.

Nothing outside this package imports it; ``queries`` holds the thin registered queries.
"""
