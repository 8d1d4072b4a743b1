"""Operators for preparing text corpora: deduplication, filtering, scoring, privacy and encoding."""
