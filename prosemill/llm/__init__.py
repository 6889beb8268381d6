"""Operators for preparing training data: selection, de-duplication, packing, formatting, encoding.

Nothing outside this subpackage imports it.
"""
