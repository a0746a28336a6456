"""Vehicle-fleet sensing analytics on Spark: DataFrames in, lazy DataFrames out."""
