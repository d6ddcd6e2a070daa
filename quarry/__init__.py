"""quarry: search-relevance analytics on Spark, declared with the DataFrame API."""
