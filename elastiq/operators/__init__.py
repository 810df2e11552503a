"""The steps of a run, each a function from DataFrames to a DataFrame."""
