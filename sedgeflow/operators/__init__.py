"""Operators over event facts and change logs: DataFrames in, DataFrames out."""
