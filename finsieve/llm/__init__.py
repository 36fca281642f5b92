"""Operators for preparing text corpora and training data."""
