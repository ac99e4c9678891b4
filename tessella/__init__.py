"""Tessella: analytics over labelled-image corpora as Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame; Catalyst plans the work.
"""
