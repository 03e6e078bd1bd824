"""Training-data operators: archives, deduplication, filtering, tokens, search."""
