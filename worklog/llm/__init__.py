"""Operators for preparing training text: deduplication, filtering, mixing, encoding and storage."""
