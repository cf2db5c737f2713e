"""Operators for building training data at corpus scale.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
