"""Training-data operators: deduplication, filtering, packing, sharding and search over text corpora.

Nothing else in the library imports this subpackage.
"""
