"""Operators for building training data from large document tables.  Nothing else in the library imports this."""
