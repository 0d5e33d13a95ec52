"""Interferometric imaging and relational operators on Spark DataFrames."""
