"""Spark jobs that build and check synthetic populations and travel demand."""
