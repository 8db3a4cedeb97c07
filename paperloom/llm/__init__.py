"""Operators of a training-data pipeline over whole document tables.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
