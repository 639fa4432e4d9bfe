"""Operators for training data: copies, near-duplicates, personal information, packing, leakage, subjects."""
