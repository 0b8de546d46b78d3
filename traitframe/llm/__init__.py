"""Operators for preparing text corpora: rules, scores, deduplication, mixing and token files."""
