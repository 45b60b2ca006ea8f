"""Operators for preparing training data: deduplication, mixing, packing, language, personal data."""
