"""Operators for large training-text collections. Nothing else in textloom imports this package."""
