"""Operators over change-log DataFrames; each returns a DataFrame and runs nothing."""
