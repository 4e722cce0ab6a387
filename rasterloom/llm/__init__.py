"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the entry point adds its queries only
when the folder is present.
"""
