"""Spanloom: transcript analytics on Spark DataFrames."""
