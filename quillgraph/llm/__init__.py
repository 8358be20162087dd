"""Training-data operators: deduplication, scanning, search, packing, tokens and quality.

Nothing outside this subpackage imports it.
"""
