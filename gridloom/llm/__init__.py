"""Operators for preparing language-model training data.

Nothing outside this package imports it; the entry module adds its queries only when it can be imported.
"""
