"""Operators of a training-data pipeline: rules, deduplication, packing, search, tokens."""
