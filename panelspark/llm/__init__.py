"""Operators for training-data corpora: scoring, filtering, deduplication, joins, tokenization, extraction."""
