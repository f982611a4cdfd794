"""Lineage and training-data attribution analytics on Spark DataFrames."""
