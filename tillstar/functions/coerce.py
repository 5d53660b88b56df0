"""Coercion of dirty spreadsheet values (ANSI-safe: bad input becomes NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """lower(trim(x)); NULL stays NULL."""
    return F.lower(F.trim(_c(c).cast("string")))


def parse_number(c, strip_commas: bool = False) -> Column:
    """String/number -> double, NULL when unparsable."""
    s = F.trim(_c(c).cast("string"))
    if strip_commas:
        s = F.regexp_replace(s, ",", "")
    return s.try_cast("double")


def non_negative(c, default: float = 0.0) -> Column:
    """NULL -> default, negatives clipped to 0."""
    return F.greatest(F.coalesce(_c(c), F.lit(default)), F.lit(0.0))


def parse_date(c) -> Column:
    """String/date/timestamp -> date, NULL when unparsable.

    Accepts ISO dates and timestamps (``2024-01-31``, ``2024-01-31 10:00:00``)
    and month strings (``2024-01``).
    """
    s = F.trim(_c(c).cast("string"))
    # a pattern that fails is far dearer than one that parses: each is tried on
    # texts that are long enough for it and have its separator
    def tried(pattern: str, mark: str) -> Column:
        return F.when((F.length(s) >= len(pattern)) & s.contains(mark), F.to_date(F.try_to_timestamp(s, F.lit(pattern))))
    return F.coalesce(tried("yyyy-MM-dd HH:mm:ss", ":"), tried("yyyy-MM-dd", "-"),
                      tried("yyyy/MM/dd", "/"), tried("yyyy-MM", "-"))


def strip_store_prefix(c) -> Column:
    """``Store_07`` / ``store7`` / ``7`` -> 7 (bigint), NULL when not numeric."""
    s = F.trim(F.regexp_replace(F.trim(_c(c).cast("string")), r"^[Ss]tore_?", ""))
    return s.try_cast("bigint")
