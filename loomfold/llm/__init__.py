"""Training-data operators: near-duplicate joins, vector search, privacy, media, mixing, filtering, sharding, language, line dedup, packing.

Nothing else in the library imports this subpackage.
"""
