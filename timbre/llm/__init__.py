"""Operators for building language-model training corpora.

Each module holds one operator with its own general interface; ``queries``
registers one thin query per operator over the driver's tables.  Nothing
outside this subpackage imports it.
"""
