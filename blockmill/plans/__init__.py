"""Query builders that compile to DataFrames."""
