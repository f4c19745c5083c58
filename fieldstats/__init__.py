"""Geostatistics and spatial statistics on Spark DataFrames."""
