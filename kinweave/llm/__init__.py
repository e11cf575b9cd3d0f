"""Operators for training-data pipelines: matching, similarity, tokenising, packing and quality. Nothing outside imports this package."""
