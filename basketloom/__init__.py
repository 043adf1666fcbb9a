"""Ordered-basket mining on Spark DataFrames."""
