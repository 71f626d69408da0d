"""Training-data operators: scoring, extraction, deduplication, search, mixing and encoding.

Nothing outside this subpackage imports it.
"""
