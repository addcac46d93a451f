"""Training-data operators: deduplication, packing, sharding, tokenising, filtering, formatting.

Every operator takes a DataFrame and the names of its key and text columns and returns a
DataFrame. Nothing else in the library imports this subpackage.
"""
