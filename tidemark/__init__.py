"""tidemark: versioned-data analytics on Spark DataFrames."""
