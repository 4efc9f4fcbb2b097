"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator
and the thin ``opN_`` query that applies it to its whole table.
"""
