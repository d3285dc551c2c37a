"""Training-data operators: deduplication, filtering, tokenising, scoring and sharding of text."""
