"""tidemark: event detection over measured streams, and corpus preparation, on Spark DataFrames."""
