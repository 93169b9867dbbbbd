"""Operators for training data: clusters, neighbours, packing, leakage, languages."""
