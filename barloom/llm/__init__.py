"""Training-data operators: deduplication, decontamination, extraction, archives, counts, formatting, mixing and filters."""
