"""Site-level change detection over irregular time series, on Spark DataFrames."""
