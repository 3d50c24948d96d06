"""Training-data operators: joins, de-duplication, packing, search, quality, mixing, token counts, toxicity."""
