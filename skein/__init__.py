"""Property-graph analytics on Spark DataFrames."""
