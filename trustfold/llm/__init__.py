"""Training-data operators: packing, deduplication, cleaning, scoring and sharding of documents."""
