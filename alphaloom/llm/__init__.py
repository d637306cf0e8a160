"""Training-data operators: deduplication, archives, tokens, search, quality, chat and packing."""
