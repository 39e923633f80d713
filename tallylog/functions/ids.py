"""Message identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(col: Column | str) -> Column:
    """An id without blanks (U+0020) at its ends, in small letters.

    Null, empty and blank ids are no ids: they give null.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def derived_id(*parts: Column | str) -> Column:
    """32 hex digits that depend only on the parts, joined by ':'."""
    return F.md5(F.concat_ws(":", *parts).cast("binary"))
