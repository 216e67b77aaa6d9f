"""Operators for language-data pipelines; nothing else in the library imports this."""
