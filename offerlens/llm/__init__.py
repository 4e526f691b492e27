"""Training-data operators: quality, search, archives, extraction, de-duplication, packing and URL rules."""
