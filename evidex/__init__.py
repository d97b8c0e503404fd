"""Migration evidence as Spark jobs: every function maps DataFrames to DataFrames."""
