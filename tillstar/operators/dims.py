"""Dimension builders (DIM1-DIM4) and the per-store target totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.functions.dates import date_attributes
from tillstar.functions.money import money


def store_target_totals(targets: DataFrame) -> DataFrame:
    """Per store: summed target and the first non-NULL manager (by month).

    Targets without a store id are dropped, as a pandas group-by does (D4)."""
    return (targets.where(F.col("store_id").isNotNull())
            .groupBy("store_id")
            .agg(F.sum("target_revenue").alias("target_revenue"),
                 F.min_by(F.col("manager_name"),
                          F.when(F.col("manager_name").isNotNull(),
                                 F.coalesce(F.col("month"), F.lit("9999-12-31").cast("date"))))
                 .alias("manager_name")))


def build_dim_product(products: DataFrame, sentiment: DataFrame,
                      gaps: DataFrame | None = None) -> DataFrame:
    """DIM1: product hierarchy + review sentiment (NULL -> 0) + price gap.

    ``products``: product_id, product_name, subcategory_name, category_name,
    unit_price, unit_cost. ``gaps``: product_id, competitor_price,
    price_difference, price_difference_pct.
    """
    df = products.join(sentiment, "product_id", "left").fillna(
        {"avg_sentiment": 0.0, "avg_rating": 0.0, "review_count": 0})
    if gaps is not None:
        df = df.join(gaps.select("product_id", "competitor_price", "price_difference",
                                 "price_difference_pct"), "product_id", "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in
                             ("competitor_price", "price_difference", "price_difference_pct")})
    return df.select(
        "product_id", "product_name", "subcategory_name", "category_name",
        "unit_price", "unit_cost", "competitor_price", "price_difference",
        "price_difference_pct", "avg_sentiment", "avg_rating",
        F.col("review_count").cast("long").alias("review_count"))


def build_dim_store(stores: DataFrame, totals: DataFrame) -> DataFrame:
    """DIM2: store geography + monthly/annual target + manager."""
    monthly = F.col("target_revenue").cast("double")
    return (stores.join(totals, "store_id", "left")
            .select("store_id", "store_name", "city_name", "region",
                    money(monthly).alias("monthly_target"),
                    money(monthly * 12).alias("annual_target"),
                    "manager_name"))


def build_dim_customer(customers: DataFrame) -> DataFrame:
    """DIM3: customer + city + region."""
    return customers.select("customer_id", "customer_name", "city_name", "region")


def build_dim_date(fact: DataFrame, date_col: str = "full_date") -> DataFrame:
    """DIM4: one row per distinct (non-NULL) sales date with its attributes."""
    d = fact.select(F.col(date_col).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    return d.select(*[c.alias(n) for n, c in date_attributes(F.col("_d")).items()])
