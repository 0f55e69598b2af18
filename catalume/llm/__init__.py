"""Training-data operators: dedup, mixing, sharding, decontamination, text and model scoring."""
