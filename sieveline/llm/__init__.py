"""Operators for large text corpora: quality, duplicates, extraction, tokens and packing."""
