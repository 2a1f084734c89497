"""File-catalog search and analytics on Spark DataFrames."""
