"""Operators for preparing language-model training data. Nothing else in varlens imports this."""
