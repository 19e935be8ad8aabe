"""Operators for training-data corpora: deduplication, tokenisation, scoring, archives and scans."""
