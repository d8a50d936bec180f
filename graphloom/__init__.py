"""Graph retrieval analytics as Spark DataFrames."""
