"""Top-N recommendation analytics on Spark DataFrames."""
