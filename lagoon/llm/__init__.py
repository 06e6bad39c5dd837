"""Training-data operators: counting, extraction, filtering, deduplication, packing and search."""
