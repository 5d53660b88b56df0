"""Calendar attributes of a date column (the Dim_Date contract)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(d: Column) -> Column:
    """``yyyyMMdd`` integer key of a date."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def date_attributes(d: Column) -> dict[str, Column]:
    """Columns of Dim_Date derived from date ``d``.

    day_of_week counts Monday as 0; week_of_year is the ISO week.
    """
    return {
        "date_id": date_key(d),
        "full_date": d,
        "year": F.year(d),
        "quarter": F.quarter(d),
        "month": F.month(d),
        "month_name": F.date_format(d, "MMMM"),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "day_name": F.date_format(d, "EEEE"),
        "week_of_year": F.weekofyear(d),
    }
