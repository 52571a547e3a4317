"""Spatial-grid analytics on PySpark: grids are DataFrames, operators are functions."""
