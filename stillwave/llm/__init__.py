"""Operators for preparing training text at scale; nothing else in the library imports this package.

``queries`` registers one query per operator with the SQL or brute-force test it is held against.
"""
