"""Training-data operators: filters, classifiers, near-duplicate search, scoring and packing."""
