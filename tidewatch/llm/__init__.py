"""Operators on the documents of training data; nothing outside this package imports it."""
