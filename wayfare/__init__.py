"""Sequence, route and release analytics on Spark DataFrames."""
