"""Training-data operators: language id, near-duplicates, scoring, filtering, packing."""
