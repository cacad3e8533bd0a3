"""Operators of a training-data pipeline: media columns, deduplication, classifiers, packing and formatting."""
