"""Composite queries assembled from the operators."""
