"""Text helpers for the web-log jobs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The default word delimiters of the log tokenizer are
# space, double quote, comma, opening and closing parenthesis, and star.
TOKEN_DELIMITERS = ' ",()*'
TOKEN_SPLIT_PATTERN = '[ ",()*]+'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_concat(*cols, sep: str = ":") -> Column:
    """``a:b`` composite token. Null in any part gives null (``concat``, not
    ``concat_ws``)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(_c(c))
    return F.concat(*parts)


def strip_spaces(c, pattern: str = " ") -> Column:
    """Remove every match of ``pattern`` (a regex, space by default)."""
    return F.regexp_replace(_c(c), pattern, "")


def tokenize(c) -> Column:
    """Split text into a token array on the default delimiters, dropping
    empty tokens. Null text gives null."""
    return F.filter(F.split(_c(c), TOKEN_SPLIT_PATTERN), lambda t: t != F.lit(""))
