"""Layerwise: exact graph search and distance analytics on Spark DataFrames."""
