"""Larkspur: a small analytics engine on PySpark DataFrames."""
