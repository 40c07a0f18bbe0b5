"""Training-data operators: quality, deduplication, formatting, tokenising, mixing, sharding, search."""
