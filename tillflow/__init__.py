"""Purchase-sequence analytics on Spark DataFrames."""
