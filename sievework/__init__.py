"""Package-screening analytics on Spark DataFrames."""
