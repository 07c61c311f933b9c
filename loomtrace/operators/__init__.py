"""Operators over DataFrames; every one takes column names, so it runs on any table."""
