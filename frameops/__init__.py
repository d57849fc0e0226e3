"""Detection and privacy-evaluation analytics on Spark DataFrames."""
