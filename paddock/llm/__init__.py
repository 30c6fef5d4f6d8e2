"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
column names and returns a DataFrame; ``queries`` holds the thin registered ones.
"""
