"""Operators that turn a corpus into training data. Nothing else in the package imports this one."""
