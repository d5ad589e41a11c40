"""Operators for text and training data; nothing outside imports this package."""
