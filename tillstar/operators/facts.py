"""Fact building: costs, shipping, marketing allocation, net profit, ROI.

Scale notes
-----------
* The marketing allocation needs the revenue total of each (category, month)
  on every sale. A window over (category, month) or a shuffle join would
  hash the whole fact onto a handful of keys (few categories x months = few,
  huge partitions). Instead the totals are pre-aggregated (partial
  aggregation, map-side combine), materialised, counted, and joined back by
  broadcast when the count is below a bound; beyond it the planner's
  shuffle join (with AQE skew splitting) is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.functions.money import MONEY, dec

# Size bound for broadcasting a (category, month) table.
BROADCAST_MAX_ROWS = 2_000_000


def category_month_revenue(sales: DataFrame) -> DataFrame:
    """Revenue total per (category, month); NULL keys dropped (D4)."""
    return (sales.where(F.col("category").isNotNull() & F.col("month").isNotNull())
            .groupBy("category", "month")
            .agg(F.sum("total_revenue").alias("cat_month_total")))


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      materialize=None) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven <= ``max_rows``.

    ``materialize`` (DataFrame -> DataFrame) writes the table once so the
    count and the later join read the same, already computed data.
    """
    if materialize is not None:
        df = materialize(df)
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def allocate_marketing(sales: DataFrame, totals_and_spend: DataFrame) -> DataFrame:
    """FCT2: allocated = revenue / category-month revenue * category-month spend.

    ``totals_and_spend``: (category, month, cat_month_total, marketing_cost_local).
    Missing spend or a zero total allocate 0. Row values are rounded to 4
    digits and stored as DECIMAL so every later sum is exact.
    """
    share = F.try_divide(F.col("total_revenue").cast("double"),
                         F.col("cat_month_total").cast("double"))
    alloc = share * F.col("marketing_cost_local").cast("double")
    return (sales.join(totals_and_spend, ["category", "month"], "left")
            .withColumn("marketing_cost",
                        F.coalesce(alloc.cast("decimal(38,6)").cast(MONEY),
                                   F.lit(0).cast(MONEY)))
            .drop("cat_month_total", "marketing_cost_local"))


def profit_columns(df: DataFrame) -> DataFrame:
    """FCT1: cost, shipping, gross and net profit (NULL costs count as 0)."""
    zero = F.lit(0).cast(MONEY)
    qty = F.col("quantity").cast("decimal(10,0)")
    cost = F.coalesce((dec("unit_cost") * qty).cast(MONEY), zero)
    ship = F.coalesce((dec("shipping_rate") * qty).cast(MONEY), zero)
    df = df.withColumns({"product_cost": cost, "shipping_cost": ship})
    df = df.withColumn("gross_profit",
                       (F.col("total_revenue") - F.col("product_cost")).cast(MONEY))
    net = F.col("gross_profit") - F.col("shipping_cost") - F.col("marketing_cost")
    return df.withColumn("net_profit", F.round(net, 2).cast(MONEY))


def marketing_roi_monthly(fact: DataFrame) -> DataFrame:
    """FCT3: per (category, month) revenue, allocated spend and ROI %.

    ROI = (revenue - spend) / spend * 100, rounded to 2 digits; a zero spend
    gives 0 (the modelled pipeline maps +-inf to 0; 0/0 becomes NULL).
    """
    g = (fact.where(F.col("category").isNotNull())
         .groupBy("category", F.date_format("month_start", "yyyy-MM").alias("month"))
         .agg(F.sum("total_revenue").alias("rev"), F.sum("marketing_cost").alias("spend")))
    rev = F.col("rev").cast("double")
    spend = F.col("spend").cast("double")
    roi = (F.when(spend != 0, F.round(((rev - spend) * 100.0 / spend).cast("decimal(38,6)"), 2)
                  .cast("double"))
           .when(rev != 0, F.lit(0.0)))
    return g.select(
        "category", "month",
        F.round("rev", 2).cast("double").alias("total_revenue"),
        F.round("spend", 2).cast("double").alias("marketing_cost"),
        roi.alias("roi_percent"))
