"""Operators of a training-data pipeline over document, page and vector tables.

Nothing outside this package imports it. ``catalog`` holds the queries, ``oracles`` their SQL.
"""
