"""Operators that prepare training data: deduplication, filters, mixing, encoding, extraction and vector search."""
