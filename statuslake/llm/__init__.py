"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface; ``queries``
registers one ``opN_<name>`` query for each and derives the digest columns from the operator's real outputs.
"""
