"""Operators for preparing training data: text quality, deduplication, mixing, packing, archives."""
