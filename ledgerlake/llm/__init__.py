"""Training-data operators: filtering, deduplication, mixing, sharding, packing, formatting.

Nothing else in the library imports this subpackage. Each module holds one operator with a
general interface; ``queries`` holds the registered queries and their DuckDB twins.
"""
