"""Event-history analytics on Spark DataFrames."""
