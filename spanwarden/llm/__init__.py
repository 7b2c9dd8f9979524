"""Training-data operators (packing, deduplication, quality, scoring, token output). Nothing else in the library imports this."""
