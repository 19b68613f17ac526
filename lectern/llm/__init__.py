"""Operators for training-data pipelines: scoring, deduplication, search,
tokenising, packing and archives.  Nothing else in the library imports this
subpackage."""
