"""Training-data operators: tokenising, packing, deduplication, scoring, search.

Nothing else in the library imports this subpackage.
"""
