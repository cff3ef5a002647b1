"""Operators for preparing large text corpora, one module each.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``queries.py`` applies each to its whole table.
"""
