"""Approximate string, entity and spatial keyword queries on PySpark DataFrames."""
