"""Engineering-seismology analytics on Spark DataFrames."""
