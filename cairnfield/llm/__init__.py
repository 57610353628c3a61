"""Training-data operators: sharding, search, decontamination, tokens, dedup, classifiers."""
