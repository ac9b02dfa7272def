"""Text expressions: punctuation, whitespace, tokens and their offsets.

Offsets are code points, 0-based and half-open, like Python string slices;
Spark's ``length`` and ``regexp_*`` work in code points as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from errata.constants import (ASCII_PUNCT, PUNCT_FROM, PUNCT_TO, PY_WS,
                              PY_WS_BODY, WORD_CHAR)
from errata.functions.letbind import let, sql_str

# A word is letters/marks/digits joined by single hyphens or apostrophes; any
# other non-blank code point is a token of its own.
TOKEN_RE = (WORD_CHAR + r"+(?:[-']" + WORD_CHAR + r"+)*"
            + r"|[^\p{L}\p{M}\p{N}" + PY_WS_BODY + "]")
STRIP_RE = "^" + PY_WS + "+|" + PY_WS + r"+\z"


def normalise_punct(c: Column) -> Column:
    """Map 24 code points one to one, so offsets stay valid."""
    return F.translate(c, PUNCT_FROM, PUNCT_TO)


def py_strip(c: Column) -> Column:
    """Strip Python whitespace at both ends."""
    return F.regexp_replace(c, STRIP_RE, "")


def blank_whitespace(c: Column) -> Column:
    """P5 first step: every whitespace code point becomes one blank."""
    return F.regexp_replace(c, PY_WS, " ")


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def clean_text(c: Column) -> Column:
    """P5: whitespace to blanks, runs to one, one leading blank removed."""
    return F.regexp_replace(collapse_blanks(blank_whitespace(c)), "^ ", "")


def strip_ascii_punct(c: Column) -> Column:
    """Strip whitespace, then ASCII punctuation, at both ends."""
    return F.trim(py_strip(c), F.lit(ASCII_PUNCT))
