"""Ranked text search on Spark DataFrames."""
