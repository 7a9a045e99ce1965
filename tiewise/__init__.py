"""Longitudinal network analytics on Spark DataFrames."""
