"""Channel identifiers NET.STA.LOC.CHA as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(c: Column | str) -> Column:
    """Upper case, four codes joined by dots, a blank location code empty.

    Accepts ``.``, ``_``, ``-`` and ``/`` as separators and ``--``, ``__`` or blanks as an
    empty location code.  Null stays null.
    """
    s = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    s = F.regexp_replace(s, r"([./])\s*(?:--|__|\s+)\s*([./])", "$1$2")
    return F.regexp_replace(F.translate(s, "_-/", "..."), r"\s+", "")


def split_id(c: Column | str) -> Column:
    """Array of exactly four codes, padded with '' and cut after the fourth."""
    c = F.col(c) if isinstance(c, str) else c
    return F.slice(F.concat(F.split(c, r"\."), F.array(*[F.lit("")] * 4)), 1, 4)


def inst_code(c: Column | str) -> Column:
    """Second character of the channel code; '' where the code is shorter than two."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"\.[^.]([^.])[^.]*$", 1)


def wildcard_to_regex(pattern: str) -> str:
    """Web-service wildcards (``?`` one, ``*`` any) as an unanchored regular expression."""
    return "".join({"?": ".", "*": ".*"}.get(ch, re.escape(ch)) for ch in pattern)
