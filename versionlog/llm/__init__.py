"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Modules hold one operator each;
``queries`` and ``oracles`` hold the registered queries and their SQL.
"""
