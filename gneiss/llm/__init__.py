"""Training-data operators: near-duplicates, filters, classifiers, tokenising, mixing."""
