"""tidemark: causal-graph time-series analytics on Spark DataFrames."""
