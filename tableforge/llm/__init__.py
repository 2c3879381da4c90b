"""Operators for large text corpora: cleaning, deduplication, scoring, search and encoding."""
