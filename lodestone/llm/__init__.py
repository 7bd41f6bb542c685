"""Operators of a training-data pipeline: duplicates, contamination, formats, tokens, scores, neighbours."""
