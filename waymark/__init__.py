"""Road-network analytics on Spark: graphs as DataFrames, questions as plans."""
