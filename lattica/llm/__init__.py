"""Operators of a training-data pipeline: quality, language, tokens, PII, mixing, near copies, scoring.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame with an id column and a
text column, reads whole texts, and returns one row per input row unless its docstring says otherwise.
Shared rules: a null text is read as the empty text, a null id is kept as an ordinary value, repeated
rows give repeated result rows, an empty table gives an empty result, and columns an operator does not
name are ignored (so clashing names cannot reach it).
"""
