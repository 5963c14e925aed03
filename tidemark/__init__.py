"""Point-in-time event-market analytics on Spark DataFrames."""
