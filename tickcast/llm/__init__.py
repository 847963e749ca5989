"""Training-data operators on Spark: deduplication, filtering, packing, search.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
