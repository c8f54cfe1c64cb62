"""Training-data operators: deduplication, filters, tokenizers, packing and vector search."""
