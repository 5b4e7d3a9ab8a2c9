"""Training-data operators: deduplication, quality, toxicity, mixing, packing, WARC and chat formatting."""
