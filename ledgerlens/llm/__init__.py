"""Operators of a training-data pipeline: dedup, joins, search, mixing, coding, classifiers.

Nothing else in the library imports this folder. `catalog` registers one query an operator.
"""
