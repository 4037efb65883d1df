"""Pull-request analytics on Spark DataFrames."""
