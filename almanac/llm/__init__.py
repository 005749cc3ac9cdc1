"""Operators for preparing language-model training text, independent of the rest of the library."""
