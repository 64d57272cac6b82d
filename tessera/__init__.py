"""Analytics operators, functions, sources and streaming on PySpark DataFrames."""

__version__ = "0.1.0"
