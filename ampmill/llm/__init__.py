"""Operators for text and training data; nothing outside this subpackage imports it."""
