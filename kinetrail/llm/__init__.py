"""Training-data operators: the corpus operators and the queries that apply them.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
