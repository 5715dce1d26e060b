"""Operators for training data: neighbours, grouped splits, overlaps, token ids, leaks and page quality."""
