"""Operators for training-data pipelines: mixing, sharding, quality, scoring, deduplication, archives, scans and filters."""
