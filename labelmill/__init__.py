"""Weak labelling and evaluation of large document collections on Spark."""
