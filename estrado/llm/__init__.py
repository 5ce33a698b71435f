"""Operators for training text and record linkage. Nothing outside this package imports it."""
