"""Operators that prepare catalogue and log texts as training data for language models.

Everything here stands on the rest of the library; nothing else in the library
stands on it.
"""
