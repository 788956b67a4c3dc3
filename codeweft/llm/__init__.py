"""Training-data operators over ``documents``-shaped tables.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
