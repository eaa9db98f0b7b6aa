"""Multivector document retrieval on Spark DataFrames."""

__version__ = "0.3.0"
