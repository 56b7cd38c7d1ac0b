"""Survey, text and corpus analytics on Spark DataFrames."""
