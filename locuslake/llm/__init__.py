"""Training-data operators: extraction, filtering, deduplication, scoring and packing.

Nothing else in the library imports this subpackage.
"""
