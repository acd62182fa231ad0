"""Training-data operators: formatting, deduplication, decontamination, scoring and mixing."""
