"""Training-data operators: chat formatting, tokenization, deduplication, classification, packing, sharding."""
