"""Operators: each takes and returns DataFrames and leaves scheduling to Catalyst."""
