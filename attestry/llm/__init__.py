"""Training-data operators: tokenising, filtering, deduplication, packing, search and scoring.

Nothing outside this subpackage imports it.
"""
