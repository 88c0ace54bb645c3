"""Operators of a training-data pipeline: deduplication, filters, search, tokens and web archives."""
