"""Operators of a training-data pipeline: search, deduplication, tokens, privacy, packing.

Nothing outside this package imports it.
"""
