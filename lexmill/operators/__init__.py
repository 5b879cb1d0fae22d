"""Table preparation, encoding, training, scoring, metrics and run tables."""
