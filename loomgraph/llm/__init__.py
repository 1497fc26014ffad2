"""Operators for preparing training data at large scale. Nothing outside imports this package."""
