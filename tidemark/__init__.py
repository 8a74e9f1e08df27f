"""Operators on timestamped events, intervals and series, as PySpark DataFrames."""
