"""Raster analytics on PySpark DataFrames."""
