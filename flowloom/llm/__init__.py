"""Operators that prepare training data: filters, deduplication, mixing, packing, formats."""
