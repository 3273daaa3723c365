"""Training-data operators: tokenisation, deduplication, filtering, extraction, archives and search.

Nothing outside this subpackage imports it.
"""
