"""Logical plans of a fit: which terms a model has and how their columns are laid out."""
