"""Operators: each answers one question about a table as a DataFrame or as a small driver-side result."""
