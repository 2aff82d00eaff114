"""Training-data operators: near and exact dedup, filtering, mixing, packing."""
