"""Text search and web-corpus analytics on Spark DataFrames."""
