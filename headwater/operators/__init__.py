"""Lineage, attribution, valuation and ETL operators over DataFrames."""
