"""Training-data operators: encoding, packing, deduplication, filtering, search.

Nothing outside this subpackage imports it.
"""
