"""DataFrame operators: lazy functions from DataFrames to DataFrames."""
