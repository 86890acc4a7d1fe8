"""Deterministic raster analytics on Spark DataFrames."""
