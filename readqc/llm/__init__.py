"""Training-data operators: mixing, dedup, scoring, scans and search over document tables."""
