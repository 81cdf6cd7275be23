"""Operators for large text corpora, written over Spark DataFrames.

Nothing outside this package imports it. Each module holds one operator with a
general interface; ``queries.py`` holds the thin queries that the entry point
registers.
"""
