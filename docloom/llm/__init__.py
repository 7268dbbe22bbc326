"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Conventions shared by all
operators: a null text counts as the empty text unless the operator's docstring
says otherwise, labels are never read while scoring, input columns that an
operator does not need are carried through untouched or left out of a digest
query, and an empty table gives an empty result with the same schema.
"""
