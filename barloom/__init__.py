"""Market time series on Spark: bars, as-of alignment, features, windows, quality rules and evaluation as DataFrames."""
