"""Operators of a training-data pipeline: filtering, deduplication, extraction and mixing of text corpora."""
