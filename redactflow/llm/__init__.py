"""Training-data operators: extraction, deduplication, scoring and packing of text tables."""
