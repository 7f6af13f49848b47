"""Operators for large training corpora: deduplication, extraction, filtering, mixing, search."""
