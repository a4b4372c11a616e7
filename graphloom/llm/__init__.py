"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; every operator takes and
returns DataFrames and can be used on its own.
"""
