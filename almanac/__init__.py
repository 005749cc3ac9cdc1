"""Health-log and weather time-series analytics on Spark DataFrames."""
