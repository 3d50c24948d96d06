"""Revisioned-dataset analytics on PySpark DataFrames."""
