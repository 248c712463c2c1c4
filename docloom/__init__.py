"""Document retrieval analytics on Spark DataFrames."""
