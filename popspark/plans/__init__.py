"""Queries over the given tables, and the adapter that shapes these."""
