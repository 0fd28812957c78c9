"""Alignment and interval analytics on Spark DataFrames."""
