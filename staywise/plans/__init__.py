"""Assembled jobs over the given tables."""
