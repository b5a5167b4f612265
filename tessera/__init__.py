"""Evidence retrieval, relationship analytics and corpus preparation on Spark DataFrames."""
