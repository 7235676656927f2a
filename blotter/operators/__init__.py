"""Relational operators: cleaning, features, splits, fitted transforms, metrics."""
