"""Labelled time-series, vector and training-data analytics on Spark DataFrames."""
