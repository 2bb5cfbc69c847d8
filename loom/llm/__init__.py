"""Operators for preparing language-model training corpora.

Each module holds one operator with a general interface and the thin query
that applies it to the driver's ``documents`` table.  Nothing outside this
subpackage imports it.
"""
