"""Training-data operators: near-duplicates, language, scoring, filters, packing and search."""
