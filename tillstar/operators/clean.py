"""Cleaning of the three flat files (marketing spend, monthly targets,
shipping rates) and currency harmonisation.

Bad numbers and dates become NULL (never an error: Spark runs ANSI mode),
money NULLs become 0 and negatives are clipped to 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.functions.coerce import (
    clean_text, non_negative, parse_date, parse_number, strip_store_prefix,
)

# Fixed value of the modelled pipeline: USD -> local currency (DZD).
USD_TO_LOCAL = 135.0


def clean_marketing(df: DataFrame) -> DataFrame:
    """CLN1: dedup, category lower/trim, date parsed, spend >= 0."""
    return df.dropDuplicates().withColumns({
        "category": clean_text("category"),
        "date": parse_date(F.col("date")),
        "marketing_cost_usd": non_negative(parse_number("marketing_cost_usd")),
    })


def clean_targets(df: DataFrame) -> DataFrame:
    """CLN2: dedup, month parsed, ``Store_07`` -> 7, ``1,200`` -> 1200 >= 0."""
    return df.dropDuplicates().withColumns({
        "month": parse_date(F.col("month")),
        "store_id": strip_store_prefix("store_id"),
        "target_revenue": non_negative(parse_number("target_revenue", strip_commas=True)),
    })


def clean_shipping(df: DataFrame) -> DataFrame:
    """CLN3: dedup, region lower/trim, cost >= 0."""
    return df.dropDuplicates().withColumns({
        "region_name": clean_text("region_name"),
        "shipping_cost": non_negative(parse_number("shipping_cost")),
    })


def harmonize_currency(marketing: DataFrame, rate: float = USD_TO_LOCAL) -> DataFrame:
    """CLN4: add ``marketing_cost_local`` = round(usd * rate, 2) (exact decimal)."""
    usd = F.col("marketing_cost_usd").cast("decimal(18,2)")
    return marketing.withColumn(
        "marketing_cost_local",
        F.round(usd * F.lit(rate).cast("decimal(12,4)"), 2).cast("decimal(18,2)"))


def spend_per_category_month(marketing: DataFrame) -> DataFrame:
    """Spend aggregated per (category, month): several campaigns in one
    category-month are summed instead of duplicating fact rows (D7).
    Rows with a NULL category or date are dropped, as a pandas group-by does."""
    return (marketing
            .where(F.col("category").isNotNull() & F.col("date").isNotNull())
            .groupBy("category", F.trunc("date", "month").alias("month"))
            .agg(F.sum("marketing_cost_local").alias("marketing_cost_local")))
