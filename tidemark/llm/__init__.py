"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage; ``registry`` holds its
queries and the SQL they are checked against.
"""
