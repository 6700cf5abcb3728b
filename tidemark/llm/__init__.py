"""Operators for large-scale training-data preparation (dedup, filters, mixing, tokenisation).

Nothing else in the package imports this subpackage, and it can be removed whole.
"""
