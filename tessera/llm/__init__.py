"""Operators for preparing large text corpora for model training.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` holds the thin registered
queries and ``sql`` their SQL twins.
"""
