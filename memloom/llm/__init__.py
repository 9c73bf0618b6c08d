"""Operators of a training-data pipeline: scoring, near-copies, tokens, shards, packing."""
