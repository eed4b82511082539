"""Operators of a training-data pipeline: deduplication, tokenizers, classifiers, packing, sharding, search."""
