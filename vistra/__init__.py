"""Spatio-temporal relation analytics on Spark DataFrames."""
