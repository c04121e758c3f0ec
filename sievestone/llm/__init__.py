"""Operators for preparing language-model training data, each a module of its own.

``queries`` in this folder registers one query for each operator; nothing
outside this folder imports it.
"""
