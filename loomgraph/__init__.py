"""Sparse algebra and graph analytics on Spark DataFrames."""
