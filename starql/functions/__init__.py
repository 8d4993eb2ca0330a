"""Scalar and aggregate expressions: types and translation to columns."""
