"""Training-data operators: counts, scans, dedup, classifiers, mixing."""
