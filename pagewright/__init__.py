"""Paged-storage analytics expressed as Spark DataFrames."""
