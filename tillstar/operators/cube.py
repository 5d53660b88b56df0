"""Mergeable sales aggregate that answers the filtered KPIs without the fact.

One row a day, region, category and subcategory: exact sums and counts, so that
rows merge by adding up (:func:`merge`) and every average or ratio is computed
from merged sums, as over the fact. The size is bounded by days x regions x
pairs of category and subcategory, whatever the number of sales. Distinct ids
don't add up over groups; they are kept as ids, one row each
(:func:`distinct_ids`).

A filter by store is finer than this grain: :func:`covers` says so, and the
caller then reads the fact. NULL dimension values are groups of their own and
match no filter, as in the fact. No rows give NULL sums and a count of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstar.functions.money import money
from tillstar.operators import metrics as MT
from tillstar.operators.filters import SalesFilter, apply_filter

GRAIN = ("full_date", "year", "month", "month_name", "store_region", "category_name", "subcategory_name")
MEASURES = ("n_rows", "total_revenue", "n_revenue", "net_profit", "quantity", "n_quantity", "target",
            "sentiment", "n_sentiment")
ID_COLUMNS = ("customer_id", "product_id", "store_id")


def build(star: DataFrame) -> DataFrame:
    """The aggregate of ``star``: one partial aggregation, one small shuffle."""
    score = F.col("sentiment_score").cast("decimal(10,4)")
    return star.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("total_revenue").alias("total_revenue"), F.count("total_revenue").alias("n_revenue"),
        F.sum("net_profit").alias("net_profit"),
        F.sum("quantity").alias("quantity"), F.count("quantity").alias("n_quantity"),
        F.sum(MT._target_expr()).alias("target"),
        F.sum(score).alias("sentiment"), F.count(score).alias("n_sentiment"))


def merge(*cubes: DataFrame) -> DataFrame:
    """Aggregates of disjoint sales as one."""
    rows = cubes[0]
    for other in cubes[1:]:
        rows = rows.unionByName(other)
    schema = cubes[0].schema
    return rows.groupBy(*GRAIN).agg(*[F.sum(c).cast(schema[c].dataType).alias(c) for c in MEASURES])


def distinct_ids(star: DataFrame) -> DataFrame:
    """(kind, id): the customers, products and stores with a sale."""
    out = None
    for c in ID_COLUMNS:
        ids = (star.where(F.col(c).isNotNull()).select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id"))
               .distinct())
        out = ids if out is None else out.unionByName(ids)
    return out


def covers(flt: SalesFilter | None) -> bool:
    return flt is None or not flt.stores


def _ratio(total: str, count: str, scale: int = 2) -> Column:
    return money(F.try_divide(F.sum(total).cast("double"), F.sum(count).cast("double")), scale)


def kpi_bundle(cube: DataFrame, dim_product: DataFrame, flt: SalesFilter | None = None) -> DataFrame:
    g = apply_filter(cube, flt).agg(
        F.sum("total_revenue").alias("_rev"), F.sum("net_profit").alias("_np"), F.sum("target").alias("_tgt"),
        _ratio("sentiment", "n_sentiment", 3).alias("_sent"))
    reached = F.when(F.col("_tgt") > 0, money(F.col("_rev").cast("double") * 100.0 / F.col("_tgt").cast("double")))
    everywhere = MT.kpi_avg_sentiment_global(dim_product).scalar()
    return g.select(
        F.coalesce(money("_rev"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(money("_np"), F.lit(0.0)).alias("net_profit"),
        F.coalesce(reached, F.lit(0.0)).alias("target_achievement"),
        F.coalesce("_sent", everywhere, F.lit(0.0)).alias("avg_sentiment"))


def monthly_trends(cube: DataFrame, flt: SalesFilter | None = None) -> DataFrame:
    return (apply_filter(cube, flt).groupBy("year", "month", "month_name")
            .agg(F.sum("n_rows").alias("transaction_count"),
                 MT.rsum("total_revenue").alias("monthly_revenue"),
                 MT.rsum("net_profit").alias("monthly_profit"),
                 _ratio("total_revenue", "n_revenue").alias("avg_transaction_value"))
            .select("year", "month", "month_name", F.format_string("%d-%02d", "year", "month").alias("year_month"),
                    "transaction_count", "monthly_revenue", "monthly_profit", "avg_transaction_value")
            .orderBy(F.desc("year"), F.desc("month")))


def dashboard_summary(cube: DataFrame, ids: DataFrame) -> DataFrame:
    """Over all sales: ids under a filter are in the fact only."""
    def unique(column):
        return ids.where(F.col("kind") == column).agg(F.count(F.lit(1))).scalar()
    return cube.agg(
        F.min("full_date").alias("start_date"), F.max("full_date").alias("end_date"),
        F.coalesce(F.sum("n_rows"), F.lit(0).cast("long")).alias("total_transactions"),
        MT.rsum("total_revenue").alias("total_revenue"), MT.rsum("net_profit").alias("total_profit"),
        _ratio("total_revenue", "n_revenue").alias("avg_transaction_value"),
        MT.margin_pct().alias("overall_profit_margin"),
        F.sum("quantity").alias("total_units_sold"),
        _ratio("quantity", "n_quantity").alias("avg_quantity_per_transaction")).select(
        "*", unique("customer_id").alias("unique_customers"), unique("product_id").alias("unique_products"),
        unique("store_id").alias("unique_stores"))
