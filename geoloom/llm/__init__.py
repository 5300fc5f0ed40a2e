"""Operators for preparing training data, all on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
