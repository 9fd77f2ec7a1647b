"""Training-data operators: scoring, dedup, formatting, packing, tokenising."""
