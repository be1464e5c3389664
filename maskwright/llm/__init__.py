"""Operators of a training-data pipeline: duplicates, scoring, personal data, packing, formatting, filters, mixing, search."""
