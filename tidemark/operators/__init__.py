"""Operators: functions from DataFrames to a DataFrame, with the evaluation time passed in."""
