"""Operators for text and duplicate groups; nothing else in the library imports this package."""
