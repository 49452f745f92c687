"""Operators for building training data: one module per operator, each with its registered query."""
