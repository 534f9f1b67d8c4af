"""Training-data operators: chat, tokens, language, WARC, URLs, duplicates, quality and packing."""
