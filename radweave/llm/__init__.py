"""Operators for training-data text: overlap, repair, canonical form, near-duplicates, privacy, leakage, mixing, spans."""
