"""Operators for preparing training data: search, deduplication, scans, scoring, mixing and packing of documents."""
