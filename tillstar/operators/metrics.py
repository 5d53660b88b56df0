"""Dashboard KPIs and grouped reports (sections 2.7-2.9).

Every function takes the star (the denormalised fact restricted to rows an
inner join with the date, store and product dimensions keeps) and an optional
``SalesFilter``; the filter is applied before any aggregate. Money sums are
exact DECIMAL sums rounded half-up; averages and ratios are computed in double
from the exact sums. Top-k reports order by the rounded output value (as the
modelled SQL does) with a unique tie-breaker, so the kept rows are
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions.money import money
from tillstar.operators.filters import SalesFilter, apply_filter


def rsum(c: str, scale: int = 2) -> Column:
    """Rounded exact sum."""
    return money(F.sum(c), scale)


def ravg(c: str, scale: int = 2) -> Column:
    """Rounded average (NULLs skipped) from the exact sum."""
    return money(F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double")), scale)


def margin_pct(num: str = "net_profit", den: str = "total_revenue") -> Column:
    """SUM(num) * 100 / NULLIF(SUM(den), 0), rounded."""
    return money(F.try_divide(F.sum(num).cast("double") * 100.0, F.sum(den).cast("double")))


def _target_expr() -> Column:
    """Annual target, else 12 x monthly, else 0 (exact)."""
    return F.coalesce(F.col("annual_target"), F.col("monthly_target") * 12, F.lit(0.0)) \
        .cast("decimal(18,2)")


def _f(star: DataFrame, flt: SalesFilter | None) -> DataFrame:
    return apply_filter(star, flt)


# ------------------------------------------------------------------ KPIs

def kpi_total_revenue(star, flt=None):
    return _f(star, flt).agg(rsum("total_revenue").alias("total_revenue"))


def kpi_net_profit(star, flt=None):
    return _f(star, flt).agg(rsum("net_profit").alias("net_profit"))


def kpi_total_transactions(star, flt=None):
    return _f(star, flt).agg(F.count(F.lit(1)).alias("total_transactions"))


def kpi_avg_transaction_value(star, flt=None):
    return _f(star, flt).agg(ravg("total_revenue").alias("avg_transaction_value"))


def kpi_target_achievement(star, flt=None):
    """Faithful form: the store target is summed once per sale row (D9)."""
    g = _f(star, flt).agg(F.sum("total_revenue").alias("_rev"),
                          F.sum(_target_expr()).alias("_tgt"))
    return g.select(
        money("_rev").alias("actual_sales"),
        money("_tgt").alias("total_target"),
        F.when(F.col("_tgt") > 0,
               money(F.col("_rev").cast("double") * 100.0 / F.col("_tgt").cast("double")))
        .otherwise(F.lit(0.0)).alias("achievement_percentage"))


def kpi_target_achievement_per_store(star, flt=None):
    """Corrected form: each selling store's target counted once."""
    per_store = (_f(star, flt).groupBy("store_id")
                 .agg(F.sum("total_revenue").alias("_rev"), F.max(_target_expr()).alias("_tgt")))
    g = per_store.agg(F.sum("_rev").alias("_rev"), F.sum("_tgt").alias("_tgt"))
    return g.select(
        money("_rev").alias("actual_sales"),
        money("_tgt").alias("total_target"),
        F.when(F.col("_tgt") > 0,
               money(F.col("_rev").cast("double") * 100.0 / F.col("_tgt").cast("double")))
        .otherwise(F.lit(0.0)).alias("achievement_percentage"))


def _sentiment_avg(df: DataFrame, col: str = "sentiment_score") -> Column:
    s = F.col(col).cast("decimal(10,4)")
    return money(F.try_divide(F.sum(s).cast("double"), F.count(s).cast("double")), 3)


def kpi_avg_sentiment(star, flt=None):
    """Sales-weighted: every sale row counts its product's score (D10)."""
    df = _f(star, flt)
    return df.agg(_sentiment_avg(df).alias("avg_sentiment"))


def kpi_avg_sentiment_global(dim_product):
    """Unweighted over products with a score."""
    df = dim_product.where(F.col("avg_sentiment").isNotNull())
    return df.agg(_sentiment_avg(df, "avg_sentiment").alias("avg_sentiment"))


def kpi_bundle(star, dim_product, flt=None):
    """The four headline KPIs in one pass over the star; NULL -> 0; the
    sentiment falls back to the global product average when the filtered
    one is NULL (a scalar subquery over the product dimension)."""
    df = _f(star, flt)
    g = df.agg(F.sum("total_revenue").alias("_rev"), F.sum("net_profit").alias("_np"),
               F.sum(_target_expr()).alias("_tgt"),
               _sentiment_avg(df).alias("_sent"))
    glob = kpi_avg_sentiment_global(dim_product).scalar()
    ach = F.when(F.col("_tgt") > 0,
                 money(F.col("_rev").cast("double") * 100.0 / F.col("_tgt").cast("double")))
    return g.select(
        F.coalesce(money("_rev"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(money("_np"), F.lit(0.0)).alias("net_profit"),
        F.coalesce(ach, F.lit(0.0)).alias("target_achievement"),
        F.coalesce(F.col("_sent"), glob, F.lit(0.0)).alias("avg_sentiment"))


def _distinct(df, column: str):
    """Distinct values of one column as a scalar: a pass that reads that column
    only and shuffles each value once, where several distinct counts in one
    aggregate would copy every row for each of them."""
    return F.coalesce(df.where(F.col(column).isNotNull()).select(column).distinct()
                      .agg(F.count(F.lit(1))).scalar(), F.lit(0).cast("long"))


def dashboard_summary(star, flt=None):
    df = _f(star, flt)
    return df.agg(
        F.min("full_date").alias("start_date"),
        F.max("full_date").alias("end_date"),
        F.count(F.lit(1)).alias("total_transactions"),
        rsum("total_revenue").alias("total_revenue"),
        rsum("net_profit").alias("total_profit"),
        ravg("total_revenue").alias("avg_transaction_value"),
        margin_pct().alias("overall_profit_margin"),
        F.sum("quantity").alias("total_units_sold"),
        ravg("quantity").alias("avg_quantity_per_transaction")).select(
        "*", _distinct(df, "customer_id").alias("unique_customers"),
        _distinct(df, "product_id").alias("unique_products"),
        _distinct(df, "store_id").alias("unique_stores"))


def warehouse_summary(fact):
    """Straight from the fact (no dimension join)."""
    return fact.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        money(F.sum("total_revenue").cast("double") / 1e6).alias("total_revenue_m"),
        money(F.sum("net_profit").cast("double") / 1e6).alias("total_profit_m"),
        margin_pct().alias("profit_margin_pct"),
        ravg("total_revenue").alias("avg_transaction_value")).select(
        "*", _distinct(fact, "product_id").alias("unique_products"),
        _distinct(fact, "store_id").alias("unique_stores"),
        _distinct(fact, "customer_id").alias("unique_customers"))


def financial_summary(fact):
    return fact.agg(rsum("total_revenue").alias("total_revenue"),
                    rsum("net_profit").alias("net_profit"),
                    margin_pct().alias("profit_margin_pct"))


def fact_totals(fact):
    """The unfiltered fact KPIs (no dimension join)."""
    return fact.agg(rsum("total_revenue").alias("total_revenue"),
                    rsum("net_profit").alias("net_profit"),
                    F.count(F.lit(1)).alias("total_transactions"),
                    ravg("total_revenue").alias("avg_transaction_value"))


# ------------------------------------------------------------ time series

def daily_sales(star, flt=None):
    return (_f(star, flt).groupBy("full_date", "year", "month_name", "day_name")
            .agg(F.count(F.lit(1)).alias("transactions"),
                 rsum("total_revenue").alias("daily_revenue"),
                 rsum("net_profit").alias("daily_profit"))
            .orderBy("full_date"))


def monthly_trends(star, flt=None):
    return (_f(star, flt).groupBy("year", "month", "month_name")
            .agg(F.count(F.lit(1)).alias("transaction_count"),
                 rsum("total_revenue").alias("monthly_revenue"),
                 rsum("net_profit").alias("monthly_profit"),
                 ravg("total_revenue").alias("avg_transaction_value"))
            .withColumn("year_month", F.format_string("%d-%02d", "year", "month"))
            .select("year", "month", "month_name", "year_month", "transaction_count",
                    "monthly_revenue", "monthly_profit", "avg_transaction_value")
            .orderBy(F.desc("year"), F.desc("month")))


def ytd_revenue(star, flt=None):
    """WIN1: aggregate to (year, month) first (partial aggregation), then a
    running sum per year over the small monthly result."""
    m = _f(star, flt).groupBy("year", "month").agg(F.sum("total_revenue").alias("_rev"))
    w = Window.partitionBy("year").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return (m.select("year", "month", money("_rev").alias("monthly_revenue"),
                     money(F.sum("_rev").over(w)).alias("ytd_revenue"))
            .orderBy("year", "month"))


# --------------------------------------------------------------- rankings

def top_selling_products(star, flt=None, limit: int = 15):
    g = (_f(star, flt).groupBy("product_id", "product_name", "category_name")
         .agg(F.sum("quantity").alias("units_sold"),
              rsum("total_revenue").alias("total_revenue"),
              rsum("net_profit").alias("total_profit"),
              _sentiment_avg(star).alias("avg_sentiment")))
    return (g.orderBy(F.desc("total_revenue"), F.asc("product_id")).limit(limit)
            .select("product_name", "category_name", "units_sold", "total_revenue",
                    "total_profit", "avg_sentiment"))


def category_performance(star, flt=None):
    return (_f(star, flt).groupBy("category_name")
            .agg(F.count(F.lit(1)).alias("transactions"),
                 F.sum("quantity").alias("units_sold"),
                 rsum("total_revenue").alias("total_revenue"),
                 rsum("net_profit").alias("net_profit"),
                 margin_pct().alias("profit_margin_pct"))
            .orderBy(F.desc("total_revenue"), F.asc("category_name")))


def store_ranking(star, flt=None):
    g = (_f(star, flt).where(F.col("monthly_target").isNotNull())
         .groupBy("store_id", "store_name", "store_city", "store_region", "monthly_target")
         .agg(F.count(F.lit(1)).alias("transactions"),
              F.sum("total_revenue").alias("_rev"),
              rsum("net_profit").alias("net_profit")))
    annual = F.col("monthly_target") * 12
    return (g.select(
        "store_id", "store_name", F.col("store_city").alias("city_name"),
        F.col("store_region").alias("region"), "transactions",
        money("_rev").alias("total_revenue"), "net_profit",
        money(annual).alias("annual_target"),
        money(F.try_divide(F.col("_rev").cast("double") * 100.0, annual))
        .alias("target_achievement_pct"))
        .orderBy(F.desc("net_profit"), F.asc("store_id")).drop("store_id"))


def regional_performance(star, flt=None):
    return (_f(star, flt).groupBy(F.col("store_region").alias("region"))
            .agg(F.count_distinct("store_id").alias("store_count"),
                 F.count(F.lit(1)).alias("transactions"),
                 rsum("total_revenue").alias("total_revenue"),
                 rsum("net_profit").alias("net_profit"),
                 ravg("total_revenue").alias("avg_transaction_value"))
            .orderBy(F.desc("total_revenue"), F.asc("region")))


def _with_customer(star: DataFrame) -> DataFrame:
    """4-dimension join: the customer dimension must also match."""
    return star.where(F.col("customer_known"))


def top_customers(star, flt=None, limit: int = 20):
    g = (_with_customer(_f(star, flt))
         .groupBy("customer_id", "customer_name", "customer_city", "customer_region")
         .agg(F.count(F.lit(1)).alias("purchase_count"),
              rsum("total_revenue").alias("total_spent"),
              ravg("total_revenue").alias("avg_transaction_value"),
              F.max("full_date").alias("last_purchase_date")))
    return (g.orderBy(F.desc("total_spent"), F.asc("customer_id")).limit(limit)
            .select("customer_name", F.col("customer_city").alias("city_name"),
                    F.col("customer_region").alias("region"), "purchase_count",
                    "total_spent", "avg_transaction_value", "last_purchase_date"))


def customer_geography(star, flt=None):
    return (_with_customer(_f(star, flt))
            .groupBy(F.col("customer_region").alias("region"),
                     F.col("customer_city").alias("city_name"))
            .agg(F.count_distinct("customer_id").alias("customer_count"),
                 F.count(F.lit(1)).alias("total_purchases"),
                 rsum("total_revenue").alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), F.asc("region"), F.asc("city_name")))


def profit_margin_by_category(star, flt=None):
    return (_f(star, flt).groupBy("category_name")
            .agg(F.count(F.lit(1)).alias("transactions"),
                 F.sum("quantity").alias("units_sold"),
                 rsum("total_revenue").alias("total_revenue"),
                 rsum("product_cost").alias("product_cost"),
                 rsum("shipping_cost").alias("shipping_cost"),
                 rsum("marketing_cost").alias("marketing_cost"),
                 rsum("net_profit").alias("net_profit"),
                 margin_pct().alias("profit_margin_pct"))
            .orderBy(F.desc("profit_margin_pct"), F.asc("category_name")))


def marketing_roi_by_category(star, flt=None):
    g = (_f(star, flt).where(F.col("marketing_cost") > 0)
         .groupBy("category_name")
         .agg(F.sum("marketing_cost").alias("_mc"), F.sum("total_revenue").alias("_rev"),
              rsum("net_profit").alias("net_profit")))
    return (g.select("category_name", money("_mc").alias("marketing_spend"),
                     money("_rev").alias("revenue_generated"), "net_profit",
                     money(F.try_divide((F.col("_rev") - F.col("_mc")).cast("double") * 100.0,
                                        F.col("_mc").cast("double"))).alias("roi_percentage"))
            .orderBy(F.desc("roi_percentage"), F.asc("category_name")))


def _unit_price() -> Column:
    """Per-row revenue / NULLIF(quantity, 0), fixed to 10 digits so sums are exact."""
    return F.try_divide(F.col("total_revenue").cast("double"),
                        F.col("quantity").cast("double")).cast("decimal(28,10)")


def sentiment_vs_sales(star, flt=None, limit: int = 15, min_units: int = 10):
    g = (_f(star, flt).where(F.col("sentiment_score").isNotNull())
         .withColumn("_up", _unit_price())
         .groupBy("product_id", "product_name", "category_name", "sentiment_score")
         .agg(F.sum("quantity").alias("units_sold"),
              rsum("total_revenue").alias("total_revenue"),
              ravg("_up").alias("avg_price"))
         .where(F.col("units_sold") >= min_units))
    return (g.orderBy(F.desc("units_sold"), F.asc("product_id")).limit(limit)
            .select("product_name", "category_name",
                    money("sentiment_score", 3).alias("sentiment_score"),
                    "units_sold", "total_revenue", "avg_price"))


def price_competitiveness(star, flt=None, limit: int = 10, min_sales: int = 5):
    g = (_f(star, flt).where(F.col("competitor_price").isNotNull())
         .withColumn("_up", _unit_price())
         .groupBy("product_id", "product_name", "competitor_price")
         .agg(F.count(F.lit(1)).alias("_n"),
              F.try_divide(F.sum("_up").cast("double"), F.count("_up").cast("double")).alias("_avg"))
         .where(F.col("_n") >= min_sales))
    out = g.select(
        "product_id", "product_name", money("_avg").alias("our_avg_price"),
        "competitor_price",
        money(F.try_divide((F.col("_avg") - F.col("competitor_price")) * 100.0,
                           F.col("competitor_price"))).alias("price_diff_pct"))
    return (out.orderBy(F.desc("price_diff_pct"), F.asc("product_id")).limit(limit)
            .drop("product_id"))


# ---------------------------------------------------------- star samples

def star_sample_top(star, limit: int = 5):
    s = _with_customer(star)
    return (s.orderBy(F.desc("total_revenue"), "order_key", "line_number",
                      "product_id", "store_id", "customer_id", "quantity")
            .limit(limit)
            .select("order_key", "line_number", "full_date", "product_name", "store_name",
                    "customer_name", "quantity", money("total_revenue").alias("revenue"),
                    money("net_profit").alias("profit")))


def star_sample(star, limit: int = 10):
    s = _with_customer(star)
    return (s.orderBy("order_key", "line_number", "product_id", "store_id", "customer_id",
                      "quantity", "total_revenue")
            .limit(limit)
            .select("order_key", "line_number", "full_date", "product_name", "category_name",
                    "store_name", "store_region", "customer_name", "quantity",
                    money("total_revenue").alias("total_revenue"),
                    money("net_profit").alias("net_profit")))


def sales_detailed(star, dim_product, limit: int = 1000):
    """SRC5: the denormalised sales extract (product with its unit cost,
    category, store, customer with city and region), first ``limit`` rows in
    sale order. The unit cost is looked up for those rows only."""
    order = ("order_key", "line_number", "product_id", "store_id", "customer_id", "quantity", "total_revenue")
    s = _with_customer(star).where("customer_city IS NOT NULL AND customer_region IS NOT NULL")
    cost = dim_product.select("product_id", F.col("unit_cost").cast("decimal(12,2)").alias("unit_cost"))
    return (s.orderBy(*order).limit(limit).join(cost, "product_id")
            .select("order_key", "line_number", "full_date", "quantity",
                    money("total_revenue").alias("total_revenue"), "product_name", "unit_cost",
                    "subcategory_name", "category_name", "store_name", "customer_name",
                    "customer_city", "customer_region"))


# -------------------------------------------------------- derived tables

def category_month_revenue(fact):
    return (fact.where(F.col("category").isNotNull())
            .groupBy("category", F.date_format("month_start", "yyyy-MM").alias("month"))
            .agg(rsum("total_revenue").alias("total_revenue")))


def basket_sizes(sales: DataFrame) -> DataFrame:
    """Orders, pieces and revenue by year and number of lines of an order."""
    baskets = sales.groupBy("order_key").agg(
        F.min(F.year("full_date")).alias("year"), F.count(F.lit(1)).alias("n_lines"),
        F.sum("quantity").alias("quantity"), F.sum("total_revenue").alias("revenue"))
    return baskets.groupBy("year", "n_lines").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("quantity").alias("quantity"),
        F.sum("revenue").cast("double").alias("revenue"))
