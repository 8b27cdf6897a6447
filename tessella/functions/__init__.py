"""Scalar functions and expressions, as columns."""
