"""Operators over DataFrames: folds, joins, SQL operators, skew-safe joins, small graphs."""
