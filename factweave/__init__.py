"""A program-analysis engine on Spark DataFrames."""
