"""Operators for large text corpora: quality, privacy, de-duplication, mixing, archives."""
