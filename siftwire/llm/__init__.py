"""Operators that prepare training data: filters, near-duplicate joins, mixing, tokenising, extraction."""
