"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``queries`` registers the digest queries.
"""
