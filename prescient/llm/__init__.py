"""Operators for preparing large language-model training corpora.

One module per operator; ``queries`` registers a thin query for each. Nothing
outside this subpackage imports it.
"""
