"""Training-data operators: quality, near-duplicates, media, packing, sharding, PII, mixing, toxicity."""
