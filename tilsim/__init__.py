"""Turkish text analytics and general text processing on Spark DataFrames."""

__version__ = "0.1.0"
