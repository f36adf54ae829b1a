"""Operators on DataFrames, by stage of a benchmark."""
