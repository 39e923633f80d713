"""Operators on text corpora for language models. Nothing else in the library imports this package."""
