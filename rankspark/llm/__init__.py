"""Operators of a training-data pipeline: tokens, dedup, search, sharding, packing, filters."""
