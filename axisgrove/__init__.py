"""Proximity search and training-data operators over Spark DataFrames."""
