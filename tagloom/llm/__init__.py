"""Training-data operators: scoring, filtering, deduplication, mixing, packing, search."""
