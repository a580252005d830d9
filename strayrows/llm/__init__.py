"""Operators of a training-data pipeline: filtering, deduplication, packing, encoding, archives."""
