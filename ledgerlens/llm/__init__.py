"""Operators that prepare text for training language models.

Each module holds one operator with its own interface; ``queries`` applies
them to the tables of a folder. Nothing outside this package imports it.
"""
