"""FLT1-FLT10: the dashboard filter as a Column predicate.

Parameters never enter query text: a ``SalesFilter`` becomes a conjunction of
``between`` / ``isin`` predicates on the star columns, applied before any
aggregate (Catalyst pushes it into the parquet scan; the year bound also prunes
year partitions).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Star columns the filter addresses.
DATE_COL = "full_date"
REGION_COL = "store_region"
STORE_COL = "store_name"
CATEGORY_COL = "category_name"
SUBCATEGORY_COL = "subcategory_name"


def _as_date(v) -> dt.date:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v))


@dataclass(frozen=True)
class SalesFilter:
    """Absent or empty parts are skipped; no part at all means "all rows".

    ``date_range`` may be a (start, end) pair (inclusive) or a single date
    (start = end, FLT10).
    """

    date_range: tuple | dt.date | str | None = None
    regions: tuple[str, ...] = field(default_factory=tuple)
    stores: tuple[str, ...] = field(default_factory=tuple)
    categories: tuple[str, ...] = field(default_factory=tuple)
    subcategories: tuple[str, ...] = field(default_factory=tuple)

    def bounds(self) -> tuple[dt.date, dt.date] | None:
        r = self.date_range
        if r is None or r == () or r == []:
            return None
        if isinstance(r, (tuple, list)):
            if len(r) == 1:
                return _as_date(r[0]), _as_date(r[0])
            return _as_date(r[0]), _as_date(r[1])
        d = _as_date(r)
        return d, d

    def condition(self) -> Column:
        conds: list[Column] = []
        b = self.bounds()
        if b is not None:
            conds.append(F.col(DATE_COL).between(F.lit(b[0]), F.lit(b[1])))
            # Redundant with the date bound but lets Spark prune year partitions.
            conds.append(F.col("year").between(b[0].year, b[1].year))
        for col, values in ((REGION_COL, self.regions), (STORE_COL, self.stores),
                            (CATEGORY_COL, self.categories),
                            (SUBCATEGORY_COL, self.subcategories)):
            if values:
                conds.append(F.col(col).isin(list(values)))
        return reduce(lambda a, b: a & b, conds, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        """FLT4: filter before grouping."""
        return df.where(self.condition())


ALL = SalesFilter()


def apply_filter(df: DataFrame, flt: SalesFilter | None) -> DataFrame:
    return df if flt is None else flt.apply(df)


# ---------------------------------------------------------------- FLT8/FLT9

def region_options(dim_store: DataFrame) -> DataFrame:
    return (dim_store.where(F.col("region").isNotNull())
            .select("region").distinct().orderBy("region"))


def store_options(dim_store: DataFrame, regions: list[str] | None = None) -> DataFrame:
    df = dim_store if not regions else dim_store.where(F.col("region").isin(regions))
    return (df.where(F.col("store_name").isNotNull())
            .select("store_name").distinct().orderBy("store_name"))


def category_options(dim_product: DataFrame) -> DataFrame:
    return (dim_product.where(F.col("category_name").isNotNull())
            .select("category_name").distinct().orderBy("category_name"))


def subcategory_options(dim_product: DataFrame, categories: list[str] | None = None) -> DataFrame:
    df = dim_product if not categories else dim_product.where(F.col("category_name").isin(categories))
    return (df.where(F.col("subcategory_name").isNotNull())
            .select("subcategory_name").distinct().orderBy("subcategory_name"))


def date_bounds(dim_date: DataFrame) -> DataFrame:
    return dim_date.agg(F.min("full_date").alias("min_date"), F.max("full_date").alias("max_date"))
