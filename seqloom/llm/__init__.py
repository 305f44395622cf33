"""Operators for preparing training data. Nothing else in seqloom imports this package."""
