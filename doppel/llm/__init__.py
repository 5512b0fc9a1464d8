"""Operators for building language-model training data: scoring, deduplication, packing, archives."""
