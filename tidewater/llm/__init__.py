"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and returns one; the thin queries over whole tables are in ``queries``.
"""
