"""Ridgeline: numerical and graph analytics over indexed data, as Spark DataFrames."""
