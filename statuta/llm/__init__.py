"""Operators for preparing language-model training corpora.

Each module holds one operator with its own general interface, plus the thin
``opN_*`` query that runs it over a whole table.  Nothing outside this
subpackage imports it.
"""
