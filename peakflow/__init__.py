"""Targeted extraction over sparse instrument recordings, on Spark DataFrames."""
