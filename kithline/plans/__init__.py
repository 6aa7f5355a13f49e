"""Whole flows built of the operators."""
