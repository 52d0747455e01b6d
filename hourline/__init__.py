"""hourline: harmonising, profiling and evaluating time series with Spark DataFrames."""
