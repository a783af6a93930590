"""Warehouse loads and report queries, each a function from DataFrames to a DataFrame."""
