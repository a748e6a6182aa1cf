"""Operators for large training corpora: mixing, formatting, scoring, filtering, deduplication, tokenising, writing."""
