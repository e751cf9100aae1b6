"""Training-data operators: tokens, search, quality, media, language models, mixing, packing."""
