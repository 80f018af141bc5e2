"""Operators for preparing training data: thirteen independent methods over whole tables.

Nothing else in the library imports this package; ``entry`` holds the thin
queries that the driver registers.
"""
