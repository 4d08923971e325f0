"""Training-data operators: scoring, formatting, filtering, de-duplication, counting and packing."""
