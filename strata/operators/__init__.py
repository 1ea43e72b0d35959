"""Operators over DataFrames, one module per area of the warehouse."""
