"""Exact money arithmetic.

Amounts are stored as DECIMAL so sums are exact and independent of the order
in which partitions are combined. Ratios and averages are computed in double
and then rounded through a DECIMAL(38,6) cast: rounding a decimal is HALF_UP in
Spark (and half-away-from-zero in most SQL engines), while rounding a binary
double depends on how each engine renders it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Storage type of money columns on the fact table.
MONEY = "decimal(18,4)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(c, precision: int = 18, scale: int = 4) -> Column:
    """Cast to DECIMAL(p,s) (ANSI-safe: NULL instead of an error)."""
    return _c(c).try_cast(f"decimal({precision},{scale})")


def money(c, scale: int = 2) -> Column:
    """Round to ``scale`` digits, half-up on the decimal value, as double."""
    return F.round(_c(c).cast("decimal(38,6)"), scale).cast("double")
