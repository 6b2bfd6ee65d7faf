"""Operators for large-scale training-data pipelines.

One module per operator; ``queries.py`` holds the registered queries with their
oracle SQL. Nothing else in the library imports this subpackage.
"""
