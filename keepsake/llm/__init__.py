"""Operators for training-data pipelines: packing, deduplication, quality, decontamination, tokens, extraction."""
