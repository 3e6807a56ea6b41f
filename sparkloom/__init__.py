"""Source-code intelligence on Spark DataFrames."""
