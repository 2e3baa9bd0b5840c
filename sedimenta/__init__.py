"""Declarative page-to-table extraction and record lifecycle on Spark DataFrames."""

__version__ = "0.1.0"
