"""Text primitives shared by the training-data operators.

Two word definitions occur: *terms* (runs of ASCII digits, ASCII lower-case letters and every
character from U+0080 up, after A-Z were lower-cased) and *tokens* (runs between ASCII white space).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` is byte-wise and quick on pure ASCII; any other text goes through ``translate``,
    which leaves letters outside ASCII as they are. Null stays null.
    """
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _UPPER.lower()))


def terms(col: Column) -> Column:
    """Array of the terms of a text; null and empty texts give an empty array."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(col, F.lit(""))), F.lit(TERM), F.lit(0))


def token_count(col: Column) -> Column:
    """Number of tokens of a text as a long; null counts 0."""
    return F.size(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long")
