"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` derives the registered results.
"""
