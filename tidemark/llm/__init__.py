"""Training-data operators: search, sharding, privacy, filtering, packing and near-duplicates.

Nothing else in ``tidemark`` imports this subpackage; it imports nothing from
the rest either, so that either can be removed without the other.
"""
