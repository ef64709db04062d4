"""Operators on DataFrames: each declares a plan and leaves running it to the caller."""
