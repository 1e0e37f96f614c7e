"""Late-interaction retrieval and ranking analytics on Spark DataFrames."""
