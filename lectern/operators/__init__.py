"""Operators on learning data. Each takes and returns DataFrames; keys are lists of column names."""
