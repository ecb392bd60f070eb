"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the queries that apply the
operators are in :mod:`quarry.llm.queries`.
"""
