"""Operators for building training data: mixing, filtering, deduplicating, packing and searching."""
