"""Operators for training-data pipelines: extraction, search, mixing, deduplication, packing, scans."""
