"""Operators of a training-data pipeline: search, extraction, scoring, scans, mixing, filters, dedup, tokens."""
