"""Operators over DataFrames: each returns a lazy DataFrame, none collects rows."""
