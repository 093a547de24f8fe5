"""Scalar function library: basis functions as Catalyst columns and as NumPy batches."""
