"""Operators for preparing training data: search, filters, de-duplication, mixing and packing.

Each module holds one operator with a general interface; ``catalogue`` holds the queries and
their SQL. Nothing outside this subpackage imports it.
"""
