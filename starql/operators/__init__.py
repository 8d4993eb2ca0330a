"""Relational operators: from syntax trees to DataFrames, and the rewrites Spark's optimizer does not have."""
