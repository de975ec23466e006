"""Operators: each takes DataFrames and returns a lazily built DataFrame."""
