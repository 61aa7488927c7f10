"""Operators: Column expressions. from DataFrames and parameters to DataFrames."""
