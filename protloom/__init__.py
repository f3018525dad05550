"""protloom: variant-to-protein analytics on Spark DataFrames."""
