"""Training-data operators: tokenising, packing, de-duplication, classification and search."""
