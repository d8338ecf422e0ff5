"""Training-data operators: deduplication, filtering, mixing, sharding and packing of text corpora."""
