"""Keyed-block analytics on Spark DataFrames: immutable queries, block state, merge, change feeds."""
