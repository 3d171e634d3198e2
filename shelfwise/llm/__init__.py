"""Training-data operators: deduplication, filtering, mixing, tokenising, extraction, sharding."""
