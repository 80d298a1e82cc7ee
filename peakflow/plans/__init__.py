"""What to extract: tolerances, calibration, targets, and the query plan."""
