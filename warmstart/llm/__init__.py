"""Operators of a training-data pipeline: filters, scores, deduplication, archives, counts and mixing."""
