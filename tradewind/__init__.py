"""Tradewind: e-commerce analytics as plain Spark jobs.

Every operator is a function from DataFrames to a lazy DataFrame over the canonical
column names declared in :mod:`tradewind.model`.
"""
