"""Operators for large text and record corpora. Nothing outside this package imports it."""
