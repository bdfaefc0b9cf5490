"""Operators for large text corpora: archives, shards, scans, deduplication and tokenization."""
