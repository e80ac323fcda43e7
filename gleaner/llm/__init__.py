"""Operators for large training-data corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries`` binds the operators to the driver's tables.
"""
