"""Training-data operators: quality rules, deduplication, extraction, archives, mixing and packing."""
