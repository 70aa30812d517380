"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin registered queries and their SQL; every other module holds one operator.
"""
