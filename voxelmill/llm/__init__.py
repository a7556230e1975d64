"""Operators of a training-data pipeline: filters, near-duplicates, mixing, packing and sharding."""
