"""Operators for training data: deduplication, quality, language, mixing, packing and token files."""
