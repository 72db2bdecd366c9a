"""Training-data operators: scoring, archives, quality, near duplicates, decontamination, mixing."""
