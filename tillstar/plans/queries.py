"""Query registry: every implemented report, as a Spark callable
``(spark, sf_dir) -> DataFrame`` plus, where SQL can express it, the
equivalent DuckDB SQL over the raw driver tables (the oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.functions.money import money
from tillstar.operators import cube as CB
from tillstar.operators import filters as FL
from tillstar.operators import metrics as MT
from tillstar.operators import quality as DQ
from tillstar.operators import shaping as SH
from tillstar.plans.oracle import BASE, M
from tillstar.plans.star import order_tables, sales_from_orders, warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = BASE + sql
        return fn
    return deco


def _wh(spark, sf):
    return warehouse(spark, sf)


def _cube(wh):
    return wh.derived("sales_cube", lambda: CB.build(wh.star))


def _kpi_bundle(wh, flt):
    """From the aggregate where it covers the filter, else from the fact."""
    if CB.covers(flt):
        return CB.kpi_bundle(_cube(wh), wh.table("dim_product"), flt)
    return MT.kpi_bundle(wh.star, wh.table("dim_product"), flt)


# A fixed dashboard filter exercised by the *_filtered keys.
DEMO_FILTER = FL.SalesFilter(date_range=("1997-01-01", "1998-12-31"),
                             regions=("ASIA", "EUROPE"),
                             categories=("ECONOMY", "PROMO", "STANDARD"))
_DEMO_WHERE = ("full_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' "
               "AND store_region IN ('ASIA', 'EUROPE') "
               "AND category_name IN ('ECONOMY', 'PROMO', 'STANDARD')")

# ------------------------------------------------------------- SQL snippets
SUM = lambda c: M(f"sum({c})")
AVG = lambda c, s=2: M(f"CAST(sum({c}) AS DOUBLE) / count({c})", s)
MARGIN = M("CAST(sum(net_profit) AS DOUBLE) * 100.0 / NULLIF(CAST(sum(total_revenue) AS DOUBLE), 0)")
TARGET = "CAST(coalesce(annual_target, monthly_target * 12, 0.0) AS DECIMAL(18,2))"
SENT_AVG = M("CAST(sum(CAST(sentiment_score AS DECIMAL(10,4))) AS DOUBLE) / count(sentiment_score)", 3)
UNIT_PRICE = ("CAST(CASE WHEN quantity = 0 THEN NULL ELSE CAST(total_revenue AS DOUBLE) / "
              "CAST(quantity AS DOUBLE) END AS DECIMAL(28,10))")


# ================================================================== KPIs

@register("kpi_total_revenue", f"SELECT {SUM('total_revenue')} AS total_revenue FROM star")
def q_kpi_total_revenue(spark, sf):
    return MT.kpi_total_revenue(_wh(spark, sf).star)


@register("kpi_net_profit", f"SELECT {SUM('net_profit')} AS net_profit FROM star")
def q_kpi_net_profit(spark, sf):
    return MT.kpi_net_profit(_wh(spark, sf).star)


@register("kpi_total_transactions", "SELECT count(*) AS total_transactions FROM star")
def q_kpi_total_transactions(spark, sf):
    return MT.kpi_total_transactions(_wh(spark, sf).star)


@register("kpi_avg_transaction_value",
          f"SELECT {AVG('total_revenue')} AS avg_transaction_value FROM star")
def q_kpi_avg_transaction_value(spark, sf):
    return MT.kpi_avg_transaction_value(_wh(spark, sf).star)


_TARGET_SQL = f"""
SELECT {M('_rev')} AS actual_sales, {M('_tgt')} AS total_target,
       CASE WHEN _tgt > 0 THEN {M('CAST(_rev AS DOUBLE) * 100.0 / CAST(_tgt AS DOUBLE)')} ELSE 0.0 END
         AS achievement_percentage
FROM (SELECT sum(total_revenue) AS _rev, sum({TARGET}) AS _tgt FROM star)"""


@register("kpi_target_achievement", _TARGET_SQL)
def q_kpi_target_achievement(spark, sf):
    return MT.kpi_target_achievement(_wh(spark, sf).star)


@register("kpi_target_achievement_per_store", f"""
SELECT {M('_rev')} AS actual_sales, {M('_tgt')} AS total_target,
       CASE WHEN _tgt > 0 THEN {M('CAST(_rev AS DOUBLE) * 100.0 / CAST(_tgt AS DOUBLE)')} ELSE 0.0 END
         AS achievement_percentage
FROM (SELECT sum(_rev) AS _rev, sum(_tgt) AS _tgt FROM
      (SELECT store_id, sum(total_revenue) AS _rev, max({TARGET}) AS _tgt FROM star GROUP BY store_id))""")
def q_kpi_target_achievement_per_store(spark, sf):
    return MT.kpi_target_achievement_per_store(_wh(spark, sf).star)


@register("kpi_avg_sentiment", f"SELECT {SENT_AVG} AS avg_sentiment FROM star")
def q_kpi_avg_sentiment(spark, sf):
    return MT.kpi_avg_sentiment(_wh(spark, sf).star)


@register("kpi_avg_sentiment_global", f"""
SELECT {M("CAST(sum(CAST(avg_sentiment AS DECIMAL(10,4))) AS DOUBLE) / count(avg_sentiment)", 3)}
  AS avg_sentiment FROM dim_product WHERE avg_sentiment IS NOT NULL""")
def q_kpi_avg_sentiment_global(spark, sf):
    return MT.kpi_avg_sentiment_global(_wh(spark, sf).table("dim_product"))


def _bundle_sql(where: str) -> str:
    return f"""
SELECT coalesce({M('_rev')}, 0.0) AS total_revenue, coalesce({M('_np')}, 0.0) AS net_profit,
       coalesce(CASE WHEN _tgt > 0 THEN {M('CAST(_rev AS DOUBLE) * 100.0 / CAST(_tgt AS DOUBLE)')} END, 0.0)
         AS target_achievement,
       coalesce(_sent, _gsent, 0.0) AS avg_sentiment
FROM (SELECT sum(total_revenue) AS _rev, sum(net_profit) AS _np, sum({TARGET}) AS _tgt,
             {SENT_AVG} AS _sent FROM star WHERE {where}) a,
     (SELECT {M("CAST(sum(CAST(avg_sentiment AS DECIMAL(10,4))) AS DOUBLE) / count(avg_sentiment)", 3)}
        AS _gsent FROM dim_product WHERE avg_sentiment IS NOT NULL) g"""


@register("kpi_bundle", _bundle_sql("TRUE"))
def q_kpi_bundle(spark, sf):
    wh = _wh(spark, sf)
    return MT.kpi_bundle(wh.star, wh.table("dim_product"))


@register("kpi_bundle_filtered", _bundle_sql(_DEMO_WHERE))
def q_kpi_bundle_filtered(spark, sf):
    return _kpi_bundle(_wh(spark, sf), DEMO_FILTER)


# Finer than the aggregate: read from the fact.
_STORES = tuple(f"Supplier#{i:09d}" for i in range(1, 8))
_STORE_FILTER = FL.SalesFilter(date_range=("1994-01-01", "1998-12-31"), stores=_STORES)


@register("kpi_bundle_stores", _bundle_sql(
    "full_date BETWEEN DATE '1994-01-01' AND DATE '1998-12-31' AND store_name IN ('" + "', '".join(_STORES) + "')"))
def q_kpi_bundle_stores(spark, sf):
    return _kpi_bundle(_wh(spark, sf), _STORE_FILTER)


@register("sales_cube", f"""
SELECT full_date, year, month, month_name, store_region, category_name, subcategory_name, count(*) AS n_rows,
       CAST(sum(total_revenue) AS DOUBLE) AS total_revenue, count(total_revenue) AS n_revenue,
       CAST(sum(net_profit) AS DOUBLE) AS net_profit, CAST(sum(quantity) AS BIGINT) AS quantity,
       count(quantity) AS n_quantity, CAST(sum({TARGET}) AS DOUBLE) AS target,
       CAST(sum(CAST(sentiment_score AS DECIMAL(10,4))) AS DOUBLE) AS sentiment, count(sentiment_score) AS n_sentiment
FROM star GROUP BY full_date, year, month, month_name, store_region, category_name, subcategory_name""")
def q_sales_cube(spark, sf):
    amounts = ("total_revenue", "net_profit", "target", "sentiment")
    return _cube(_wh(spark, sf)).select(
        *CB.GRAIN, *[F.col(c).cast("double").alias(c) if c in amounts else F.col(c) for c in CB.MEASURES])


@register("basket_sizes", """
, baskets AS (SELECT order_key, min(year(full_date)) AS year, count(*) AS n_lines, sum(quantity) AS quantity,
                     sum(total_revenue) AS revenue FROM sales GROUP BY order_key)
SELECT CAST(year AS INTEGER) AS year, n_lines, count(*) AS n_orders, CAST(sum(quantity) AS BIGINT) AS quantity,
       CAST(sum(revenue) AS DOUBLE) AS revenue FROM baskets GROUP BY year, n_lines""")
def q_basket_sizes(spark, sf):
    """Orders by year and number of lines, from the bucketed copies: neither the join nor the
    aggregation by order has an exchange."""
    return MT.basket_sizes(sales_from_orders(**order_tables(spark, sf, bucketed=True)))


@register("fact_totals", f"""
SELECT {SUM('total_revenue')} AS total_revenue, {SUM('net_profit')} AS net_profit,
       count(*) AS total_transactions, {AVG('total_revenue')} AS avg_transaction_value FROM fact""")
def q_fact_totals(spark, sf):
    return MT.fact_totals(_wh(spark, sf).fact)


@register("dashboard_summary", f"""
SELECT min(full_date) AS start_date, max(full_date) AS end_date, count(*) AS total_transactions,
       count(DISTINCT customer_id) AS unique_customers, count(DISTINCT product_id) AS unique_products,
       count(DISTINCT store_id) AS unique_stores, {SUM('total_revenue')} AS total_revenue,
       {SUM('net_profit')} AS total_profit, {AVG('total_revenue')} AS avg_transaction_value,
       {MARGIN} AS overall_profit_margin, CAST(sum(quantity) AS BIGINT) AS total_units_sold,
       {AVG('quantity')} AS avg_quantity_per_transaction
FROM star""")
def q_dashboard_summary(spark, sf):
    wh = _wh(spark, sf)
    return CB.dashboard_summary(_cube(wh), wh.derived("sales_ids", lambda: CB.distinct_ids(wh.star)))


@register("warehouse_summary", f"""
SELECT count(DISTINCT product_id) AS unique_products, count(DISTINCT store_id) AS unique_stores,
       count(DISTINCT customer_id) AS unique_customers, count(*) AS total_transactions,
       {M('CAST(sum(total_revenue) AS DOUBLE) / 1e6')} AS total_revenue_m,
       {M('CAST(sum(net_profit) AS DOUBLE) / 1e6')} AS total_profit_m,
       {MARGIN} AS profit_margin_pct, {AVG('total_revenue')} AS avg_transaction_value
FROM fact""")
def q_warehouse_summary(spark, sf):
    return MT.warehouse_summary(_wh(spark, sf).fact)


@register("financial_summary", f"""
SELECT {SUM('total_revenue')} AS total_revenue, {SUM('net_profit')} AS net_profit,
       {MARGIN} AS profit_margin_pct FROM fact""")
def q_financial_summary(spark, sf):
    return MT.financial_summary(_wh(spark, sf).fact)


# ============================================================ time series

@register("daily_sales", f"""
SELECT full_date, year, month_name, day_name, count(*) AS transactions,
       {SUM('total_revenue')} AS daily_revenue, {SUM('net_profit')} AS daily_profit
FROM star GROUP BY full_date, year, month_name, day_name""")
def q_daily_sales(spark, sf):
    return MT.daily_sales(_wh(spark, sf).star)


def _monthly_sql(where: str) -> str:
    return f"""
SELECT year, month, month_name, printf('%d-%02d', year, month) AS year_month,
       count(*) AS transaction_count, {SUM('total_revenue')} AS monthly_revenue,
       {SUM('net_profit')} AS monthly_profit, {AVG('total_revenue')} AS avg_transaction_value
FROM star WHERE {where} GROUP BY year, month, month_name"""


@register("monthly_trends", _monthly_sql("TRUE"))
def q_monthly_trends(spark, sf):
    return MT.monthly_trends(_wh(spark, sf).star)


@register("monthly_trends_filtered", _monthly_sql(_DEMO_WHERE))
def q_monthly_trends_filtered(spark, sf):
    return CB.monthly_trends(_cube(_wh(spark, sf)), DEMO_FILTER)


@register("ytd_revenue", f"""
SELECT year, month, {M('_rev')} AS monthly_revenue,
       {M('sum(_rev) OVER (PARTITION BY year ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')}
         AS ytd_revenue
FROM (SELECT year, month, sum(total_revenue) AS _rev FROM star GROUP BY year, month)""")
def q_ytd_revenue(spark, sf):
    return MT.ytd_revenue(_wh(spark, sf).star)


# ================================================================ rankings

def _top_products_sql(where: str, limit: int) -> str:
    return f"""
SELECT product_name, category_name, units_sold, total_revenue, total_profit, avg_sentiment FROM (
  SELECT product_id, product_name, category_name, CAST(sum(quantity) AS BIGINT) AS units_sold,
         {SUM('total_revenue')} AS total_revenue, {SUM('net_profit')} AS total_profit,
         {SENT_AVG} AS avg_sentiment
  FROM star WHERE {where} GROUP BY product_id, product_name, category_name
  ORDER BY total_revenue DESC NULLS LAST, product_id ASC LIMIT {limit})"""


@register("top_selling_products", _top_products_sql("TRUE", 15))
def q_top_selling_products(spark, sf):
    return MT.top_selling_products(_wh(spark, sf).star)


@register("top_selling_products_filtered", _top_products_sql(_DEMO_WHERE, 10))
def q_top_selling_products_filtered(spark, sf):
    return MT.top_selling_products(_wh(spark, sf).star, DEMO_FILTER, limit=10)


_CATEGORY_SQL = f"""
SELECT category_name, count(*) AS transactions, CAST(sum(quantity) AS BIGINT) AS units_sold,
       {SUM('total_revenue')} AS total_revenue, {SUM('net_profit')} AS net_profit,
       {MARGIN} AS profit_margin_pct
FROM star GROUP BY category_name"""


@register("category_performance", _CATEGORY_SQL)
def q_category_performance(spark, sf):
    return MT.category_performance(_wh(spark, sf).star)


_STORE_RANKING_SQL = f"""
SELECT store_name, store_city AS city_name, store_region AS region, count(*) AS transactions,
       {SUM('total_revenue')} AS total_revenue, {SUM('net_profit')} AS net_profit,
       {M('monthly_target * 12')} AS annual_target,
       {M('CAST(sum(total_revenue) AS DOUBLE) * 100.0 / NULLIF(monthly_target * 12, 0)')}
         AS target_achievement_pct
FROM star WHERE monthly_target IS NOT NULL
GROUP BY store_id, store_name, store_city, store_region, monthly_target"""


@register("store_ranking", _STORE_RANKING_SQL)
def q_store_ranking(spark, sf):
    return MT.store_ranking(_wh(spark, sf).star)


@register("regional_performance", f"""
SELECT store_region AS region, count(DISTINCT store_id) AS store_count, count(*) AS transactions,
       {SUM('total_revenue')} AS total_revenue, {SUM('net_profit')} AS net_profit,
       {AVG('total_revenue')} AS avg_transaction_value
FROM star GROUP BY store_region""")
def q_regional_performance(spark, sf):
    return MT.regional_performance(_wh(spark, sf).star)


@register("top_customers", f"""
SELECT customer_name, city_name, region, purchase_count, total_spent, avg_transaction_value,
       last_purchase_date FROM (
  SELECT customer_id, customer_name, customer_city AS city_name, customer_region AS region,
         count(*) AS purchase_count, {SUM('total_revenue')} AS total_spent,
         {AVG('total_revenue')} AS avg_transaction_value, max(full_date) AS last_purchase_date
  FROM star4 GROUP BY customer_id, customer_name, customer_city, customer_region
  ORDER BY total_spent DESC NULLS LAST, customer_id ASC LIMIT 20)""")
def q_top_customers(spark, sf):
    return MT.top_customers(_wh(spark, sf).star)


@register("customer_geography", f"""
SELECT customer_region AS region, customer_city AS city_name,
       count(DISTINCT customer_id) AS customer_count, count(*) AS total_purchases,
       {SUM('total_revenue')} AS total_revenue
FROM star4 GROUP BY customer_region, customer_city""")
def q_customer_geography(spark, sf):
    return MT.customer_geography(_wh(spark, sf).star)


@register("profit_margin_by_category", f"""
SELECT category_name, count(*) AS transactions, CAST(sum(quantity) AS BIGINT) AS units_sold,
       {SUM('total_revenue')} AS total_revenue, {SUM('product_cost')} AS product_cost,
       {SUM('shipping_cost')} AS shipping_cost, {SUM('marketing_cost')} AS marketing_cost,
       {SUM('net_profit')} AS net_profit, {MARGIN} AS profit_margin_pct
FROM star GROUP BY category_name""")
def q_profit_margin_by_category(spark, sf):
    return MT.profit_margin_by_category(_wh(spark, sf).star)


@register("marketing_roi_by_category", f"""
SELECT category_name, {M('_mc')} AS marketing_spend, {M('_rev')} AS revenue_generated, net_profit,
       {M('CAST(_rev - _mc AS DOUBLE) * 100.0 / NULLIF(CAST(_mc AS DOUBLE), 0)')} AS roi_percentage
FROM (SELECT category_name, sum(marketing_cost) AS _mc, sum(total_revenue) AS _rev,
             {SUM('net_profit')} AS net_profit
      FROM star WHERE marketing_cost > 0 GROUP BY category_name)""")
def q_marketing_roi_by_category(spark, sf):
    return MT.marketing_roi_by_category(_wh(spark, sf).star)


@register("sentiment_vs_sales", f"""
SELECT product_name, category_name, {M('sentiment_score', 3)} AS sentiment_score, units_sold,
       total_revenue, avg_price FROM (
  SELECT product_id, product_name, category_name, sentiment_score,
         CAST(sum(quantity) AS BIGINT) AS units_sold, {SUM('total_revenue')} AS total_revenue,
         {M(f'CAST(sum({UNIT_PRICE}) AS DOUBLE) / count({UNIT_PRICE})')} AS avg_price
  FROM star WHERE sentiment_score IS NOT NULL
  GROUP BY product_id, product_name, category_name, sentiment_score
  HAVING sum(quantity) >= 10
  ORDER BY units_sold DESC, product_id ASC LIMIT 15)""")
def q_sentiment_vs_sales(spark, sf):
    return MT.sentiment_vs_sales(_wh(spark, sf).star)


@register("price_competitiveness", f"""
SELECT product_name, {M('_avg')} AS our_avg_price, competitor_price,
       {M('(_avg - competitor_price) * 100.0 / NULLIF(competitor_price, 0)')} AS price_diff_pct
FROM (SELECT product_id, product_name, competitor_price,
             CAST(sum({UNIT_PRICE}) AS DOUBLE) / count({UNIT_PRICE}) AS _avg
      FROM star WHERE competitor_price IS NOT NULL
      GROUP BY product_id, product_name, competitor_price HAVING count(*) >= 5)
ORDER BY price_diff_pct DESC NULLS LAST, product_id ASC LIMIT 10""")
def q_price_competitiveness(spark, sf):
    return MT.price_competitiveness(_wh(spark, sf).star)


# ============================================================ star samples

@register("star_sample_top5", f"""
SELECT order_key, line_number, full_date, product_name, store_name, customer_name, quantity,
       {M('total_revenue')} AS revenue, {M('net_profit')} AS profit
FROM star4
ORDER BY total_revenue DESC, order_key, line_number, product_id, store_id, customer_id, quantity
LIMIT 5""")
def q_star_sample_top5(spark, sf):
    return MT.star_sample_top(_wh(spark, sf).star, 5)


@register("star_sample", f"""
SELECT order_key, line_number, full_date, product_name, category_name, store_name, store_region,
       customer_name, quantity, {M('total_revenue')} AS total_revenue, {M('net_profit')} AS net_profit
FROM star4
ORDER BY order_key, line_number, product_id, store_id, customer_id, quantity, total_revenue
LIMIT 10""")
def q_star_sample(spark, sf):
    return MT.star_sample(_wh(spark, sf).star, 10)


@register("sales_detailed", f"""
SELECT s.order_key, s.line_number, s.full_date, s.quantity, {M('s.total_revenue')} AS total_revenue,
       p.product_name, CAST(p.unit_cost AS DECIMAL(12,2)) AS unit_cost, p.subcategory_name, p.category_name,
       st.s_name AS store_name, c.c_name AS customer_name, n.n_name AS customer_city, r.r_name AS customer_region
FROM sales s JOIN products p ON s.product_id = p.product_id JOIN supplier st ON s.store_id = st.s_suppkey
JOIN customer c ON s.customer_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
ORDER BY s.order_key, s.line_number, s.product_id, s.store_id, s.customer_id, s.quantity, s.total_revenue
LIMIT 1000""")
def q_sales_detailed(spark, sf):
    wh = _wh(spark, sf)
    return MT.sales_detailed(wh.star, wh.table("dim_product"), 1000)


@register("marketing_roi_monthly", "SELECT * FROM marketing_roi")
def q_marketing_roi_monthly(spark, sf):
    return _wh(spark, sf).table("marketing_roi")


@register("category_month_revenue", f"""
SELECT category, strftime(month_start, '%Y-%m') AS month, {SUM('total_revenue')} AS total_revenue
FROM fact WHERE category IS NOT NULL GROUP BY category, strftime(month_start, '%Y-%m')""")
def q_category_month_revenue(spark, sf):
    return MT.category_month_revenue(_wh(spark, sf).fact)


@register("product_review_stats", "SELECT * FROM review_stats")
def q_product_review_stats(spark, sf):
    return _wh(spark, sf).table("product_review_stats")


@register("store_target_totals", """
SELECT store_id, target_revenue, manager_name FROM store_target_totals""")
def q_store_target_totals(spark, sf):
    return _wh(spark, sf).table("store_target_totals")


@register("dim_product", """
SELECT product_id, product_name, subcategory_name, category_name,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(unit_cost AS DOUBLE) AS unit_cost,
       competitor_price, price_difference, price_difference_pct, avg_sentiment, avg_rating,
       review_count FROM dim_product""")
def q_dim_product(spark, sf):
    d = _wh(spark, sf).table("dim_product")
    return d.withColumns({"unit_price": F.col("unit_price").cast("double"),
                          "unit_cost": F.col("unit_cost").cast("double")})


@register("dim_store", "SELECT * FROM dim_store")
def q_dim_store(spark, sf):
    return _wh(spark, sf).table("dim_store")


@register("dim_customer", "SELECT * FROM dim_customer")
def q_dim_customer(spark, sf):
    return _wh(spark, sf).table("dim_customer")


@register("dim_date", "SELECT * FROM dim_date")
def q_dim_date(spark, sf):
    return _wh(spark, sf).table("dim_date")


_FACT_COLS = ("order_key", "line_number", "date_id", "product_id", "store_id", "customer_id",
              "quantity")
_FACT_MONEY = ("total_revenue", "product_cost", "gross_profit", "shipping_cost",
               "marketing_cost", "net_profit")


@register("fact_sales", "SELECT " + ", ".join(
    list(_FACT_COLS) + [f"CAST({c} AS DOUBLE) AS {c}" for c in _FACT_MONEY]) + " FROM fact")
def q_fact_sales(spark, sf):
    f = _wh(spark, sf).fact
    return f.select(*_FACT_COLS, *[F.col(c).cast("double").alias(c) for c in _FACT_MONEY])


# ============================================================ filter lists

@register("filter_regions", "SELECT DISTINCT region FROM dim_store WHERE region IS NOT NULL")
def q_filter_regions(spark, sf):
    return FL.region_options(_wh(spark, sf).table("dim_store"))


@register("filter_stores", """
SELECT DISTINCT store_name FROM dim_store
WHERE region IN ('ASIA', 'EUROPE') AND store_name IS NOT NULL""")
def q_filter_stores(spark, sf):
    return FL.store_options(_wh(spark, sf).table("dim_store"), ["ASIA", "EUROPE"])


@register("filter_categories",
          "SELECT DISTINCT category_name FROM dim_product WHERE category_name IS NOT NULL")
def q_filter_categories(spark, sf):
    return FL.category_options(_wh(spark, sf).table("dim_product"))


@register("filter_subcategories", """
SELECT DISTINCT subcategory_name FROM dim_product
WHERE category_name IN ('ECONOMY', 'PROMO') AND subcategory_name IS NOT NULL""")
def q_filter_subcategories(spark, sf):
    return FL.subcategory_options(_wh(spark, sf).table("dim_product"), ["ECONOMY", "PROMO"])


@register("date_bounds", "SELECT min(full_date) AS min_date, max(full_date) AS max_date FROM dim_date")
def q_date_bounds(spark, sf):
    return FL.date_bounds(_wh(spark, sf).table("dim_date"))


# ================================================================ shaping

@register("category_share", f"""
SELECT category_name, total_revenue,
       {M('total_revenue * 100.0 / NULLIF(sum(total_revenue) OVER (), 0)')} AS share_pct
FROM ({_CATEGORY_SQL})""")
def q_category_share(spark, sf):
    c = MT.category_performance(_wh(spark, sf).star).select("category_name", "total_revenue")
    return SH.share_of_total(c, "total_revenue")


@register("category_quarter_pivot", f"""
SELECT category_name,
       {M("sum(CASE WHEN quarter = 1 THEN total_revenue END)")} AS q1,
       {M("sum(CASE WHEN quarter = 2 THEN total_revenue END)")} AS q2,
       {M("sum(CASE WHEN quarter = 3 THEN total_revenue END)")} AS q3,
       {M("sum(CASE WHEN quarter = 4 THEN total_revenue END)")} AS q4
FROM star GROUP BY category_name""")
def q_category_quarter_pivot(spark, sf):
    g = (_wh(spark, sf).star.groupBy("category_name", "quarter")
         .agg(money(F.sum("total_revenue")).alias("revenue")))
    return SH.pivot(g, "category_name", "quarter", "revenue", [1, 2, 3, 4], prefix="q")


@register("monthly_metrics_long", f"""
SELECT year_month, metric, value FROM (
  SELECT printf('%d-%02d', year, month) AS year_month,
         {SUM('total_revenue')} AS monthly_revenue, {SUM('net_profit')} AS monthly_profit
  FROM star GROUP BY year, month)
UNPIVOT (value FOR metric IN (monthly_revenue, monthly_profit))""")
def q_monthly_metrics_long(spark, sf):
    m = MT.monthly_trends(_wh(spark, sf).star)
    return SH.unpivot(m, ["year_month"], ["monthly_revenue", "monthly_profit"])


_BANDS_SQL = """
SELECT CASE WHEN avg_sentiment >= 0.5 THEN 'Very Positive' WHEN avg_sentiment >= 0.2 THEN 'Positive'
            WHEN avg_sentiment >= 0.0 THEN 'Neutral' WHEN avg_sentiment >= -0.2 THEN 'Negative'
            ELSE 'Very Negative' END AS band,
       CASE WHEN avg_sentiment > 0.3 THEN 'happy' WHEN avg_sentiment > 0.0 THEN 'neutral'
            ELSE 'sad' END AS face,
       count(*) AS product_count
FROM dim_product WHERE avg_sentiment IS NOT NULL GROUP BY 1, 2"""


@register("sentiment_bands", _BANDS_SQL)
def q_sentiment_bands(spark, sf):
    return SH.sentiment_bands(_wh(spark, sf).table("dim_product"))


@register("target_bands", f"""
SELECT CASE WHEN target_achievement_pct >= 100.0 * 0.9 THEN 'green'
            WHEN target_achievement_pct >= 100.0 * 0.7 THEN 'orange' ELSE 'red' END AS band,
       CASE WHEN target_achievement_pct >= 100.0 * 0.75 THEN 'high'
            WHEN target_achievement_pct >= 100.0 * 0.5 THEN 'mid' ELSE 'low' END AS step,
       CASE WHEN target_achievement_pct >= 100 THEN 'reached' ELSE 'below' END AS status,
       count(*) AS store_count
FROM ({_STORE_RANKING_SQL}) WHERE target_achievement_pct IS NOT NULL GROUP BY 1, 2, 3""")
def q_target_bands(spark, sf):
    return SH.target_bands(MT.store_ranking(_wh(spark, sf).star))


# ================================================================ quality

#: Every star table with the columns that the checks cover; the fact's own
#: columns, not the attributes copied into it.
_PROFILED = {
    "dim_product": ("product_id", "product_name", "subcategory_name", "category_name", "unit_price", "unit_cost",
                    "competitor_price", "price_difference", "price_difference_pct", "avg_sentiment", "avg_rating",
                    "review_count"),
    "dim_store": ("store_id", "store_name", "city_name", "region", "monthly_target", "annual_target", "manager_name"),
    "dim_customer": ("customer_id", "customer_name", "city_name", "region"),
    "dim_date": ("date_id", "full_date", "year", "quarter", "month", "month_name", "day", "day_of_week", "day_name",
                 "week_of_year"),
    "fact_sales": ("order_key", "line_number", "date_id", "product_id", "store_id", "customer_id", "quantity",
                   "total_revenue", "product_cost", "gross_profit", "shipping_cost", "marketing_cost", "net_profit"),
    "marketing_roi": ("category", "month", "total_revenue", "marketing_cost", "roi_percent"),
}
_SQL_NAME = {"fact_sales": "fact"}


def _profile_sql() -> str:
    parts = []
    for t, cols in _PROFILED.items():
        for i, c in enumerate(cols):
            parts.append(
                f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, "
                f"count({c}) AS non_null, count(*) - count({c}) AS null_count, "
                f"{M(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct FROM {_SQL_NAME.get(t, t)}")
    return " UNION ALL ".join(parts)


@register("column_profile", _profile_sql())
def q_column_profile(spark, sf):
    wh = _wh(spark, sf)
    return DQ.profile_columns(_profile(wh)).drop("dtype")


def _completeness_sql() -> str:
    parts = []
    for t, cols in _PROFILED.items():
        for i, c in enumerate(cols):
            pct = M(f"count({c}) * 100.0 / count(*)")
            parts.append(
                f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, "
                f"count({c}) AS filled, {pct} AS filled_pct, coalesce({pct}, 0.0) >= 80.0 AS complete "
                f"FROM {_SQL_NAME.get(t, t)}")
    return " UNION ALL ".join(parts)


@register("completeness", _completeness_sql())
def q_completeness(spark, sf):
    return DQ.profile_completeness(_profile(_wh(spark, sf)))


_KEYED = {"dim_product": ["product_id"], "dim_store": ["store_id"],
          "dim_customer": ["customer_id"], "dim_date": ["date_id"],
          "fact_sales": ["order_key", "line_number"]}


@register("duplicate_keys", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(coalesce(sum(_n - 1), 0) AS BIGINT) AS duplicate_keys "
    f"FROM (SELECT count(*) AS _n FROM {'fact' if t == 'fact_sales' else t} GROUP BY {', '.join(k)})"
    for t, k in _KEYED.items()))
def q_duplicate_keys(spark, sf):
    return DQ.profile_duplicates(_profile(_wh(spark, sf))).where(F.col("table_name").isin(*_KEYED))


@register("orphan_keys", """
SELECT 'product' AS dimension, count(*) AS orphan_keys FROM
  (SELECT DISTINCT product_id AS k FROM fact WHERE product_id IS NOT NULL) f
  WHERE NOT EXISTS (SELECT 1 FROM dim_product d WHERE d.product_id = f.k)
UNION ALL
SELECT 'store', count(*) FROM
  (SELECT DISTINCT store_id AS k FROM fact WHERE store_id IS NOT NULL) f
  WHERE NOT EXISTS (SELECT 1 FROM dim_store d WHERE d.store_id = f.k)
UNION ALL
SELECT 'customer', count(*) FROM
  (SELECT DISTINCT customer_id AS k FROM fact WHERE customer_id IS NOT NULL) f
  WHERE NOT EXISTS (SELECT 1 FROM dim_customer d WHERE d.customer_id = f.k)
UNION ALL
SELECT 'date', count(*) FROM
  (SELECT DISTINCT date_id AS k FROM fact WHERE date_id IS NOT NULL) f
  WHERE NOT EXISTS (SELECT 1 FROM dim_date d WHERE d.date_id = f.k)""")
def q_orphan_keys(spark, sf):
    wh = _wh(spark, sf)
    return DQ.orphan_keys(wh.fact, {
        "product": (wh.table("dim_product"), "product_id", "product_id"),
        "store": (wh.table("dim_store"), "store_id", "store_id"),
        "customer": (wh.table("dim_customer"), "customer_id", "customer_id"),
        "date": (wh.table("dim_date"), "date_id", "date_id"),
    })


_STATUS_TABLES = dict(_KEYED, marketing_roi=["category", "month"])
_STATUS_COLS = _PROFILED


def _status_sql() -> str:
    parts = []
    for t, cols in _STATUS_COLS.items():
        miss = " + ".join(f"count(*) - count({c})" for c in cols)
        key = ", ".join(_STATUS_TABLES[t])
        name = _SQL_NAME.get(t, t)
        pct = M(f"({miss}) * 100.0 / (count(*) * {len(cols)})")
        parts.append(f"""
SELECT '{t}' AS table_name, count(*) AS rows, {len(cols)} AS columns,
       CAST({miss} AS BIGINT) AS missing_values, coalesce({pct}, 0.0) AS missing_pct,
       (SELECT CAST(coalesce(sum(_n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS _n FROM {name} GROUP BY {key}))
         AS duplicate_keys,
       CASE WHEN coalesce({pct}, 0.0) < 5.0 AND
                 (SELECT coalesce(sum(_n - 1), 0) FROM (SELECT count(*) AS _n FROM {name} GROUP BY {key})) = 0
            THEN 'OK' ELSE 'WARNING' END AS status
FROM {name}""")
    return " UNION ALL ".join(parts)


@register("table_status", _status_sql())
def q_table_status(spark, sf):
    return DQ.profile_status(_profile(_wh(spark, sf)))


def _profile(wh) -> DataFrame:
    """The stored profile of the star's tables; one scan of each when it is first
    asked for."""
    from tillstar.sources.tables import literal_table
    return wh.derived("table_profile", lambda: literal_table(wh.spark, [
        r for t, k in _STATUS_TABLES.items() for r in DQ.profile(wh.table(t).select(*_STATUS_COLS[t]), t, k)], DQ.PROFILE))


_REQUIRED = {"dim_product": ("product_id", "product_name"),
             "dim_store": ("store_id", "store_name"),
             "dim_customer": ("customer_id", "customer_name"),
             "dim_date": ("date_id", "full_date"),
             "fact_sales": ("date_id", "product_id", "store_id", "customer_id"),
             "marketing_roi": ("category", "month")}


@register("not_null_violations", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS violations "
    f"FROM {'fact' if t == 'fact_sales' else t}"
    for t, cols in _REQUIRED.items() for c in cols))
def q_not_null_violations(spark, sf):
    wh = _wh(spark, sf)
    return DQ.not_null_violations({t: (wh.table(t), list(c)) for t, c in _REQUIRED.items()})


@register("contract_set_aside", """
SELECT l_orderkey, l_linenumber, l_suppkey, reason, count(*) AS rows FROM (
  SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(why, CASE WHEN row_number() OVER (
           PARTITION BY l_orderkey, l_linenumber, why IS NULL ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST,
           l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_shipdate NULLS FIRST, l_extendedprice NULLS FIRST) > 1
         THEN 'duplicate key' END) AS reason
  FROM (SELECT *, CASE WHEN l_orderkey IS NULL THEN 'null l_orderkey' WHEN l_linenumber IS NULL THEN 'null l_linenumber'
               WHEN l_shipdate IS NULL THEN 'null l_shipdate'
               WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL) THEN 'orphan l_orderkey'
               WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 'orphan l_suppkey' END AS why
        FROM lineitem)) WHERE reason IS NOT NULL
GROUP BY ALL""")
def q_contract_set_aside(spark, sf):
    """SNK3, DQ6: the sales lines that the keys of orders and of suppliers with a
    positive balance don't admit, and those that repeat a line's key."""
    from tillstar.operators.contract import Contract, write_enforced
    from tillstar.session import scratch_path
    from tillstar.sources.tables import read_table
    lines = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                               "l_extendedprice"], spread=True)
    orders = read_table(spark, sf, "orders", ["o_orderkey"])
    supplier = read_table(spark, sf, "supplier", ["s_suppkey", "s_acctbal"]).where("s_acctbal > 0")
    contract = Contract(required=("l_shipdate",), key=("l_orderkey", "l_linenumber"),
                        references={"l_orderkey": (orders, "o_orderkey"), "l_suppkey": (supplier, "s_suppkey")})
    _, aside, _ = write_enforced(lines, contract, scratch_path(spark, "contract"))
    return aside.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "reason").agg(F.count(F.lit(1)).alias("rows"))


@register("star_versions", """
SELECT CAST(year AS VARCHAR) AS part, count(*) - count(CASE WHEN year = 1998 AND discount = 0 THEN 1 END) AS rows,
       year <> 1998 AS kept
FROM (SELECT CAST(extract(year FROM l_shipdate) AS INTEGER) AS year, l_discount AS discount FROM lineitem)
GROUP BY year""")
def q_star_versions(spark, sf):
    """SNK2: the sales lines loaded by year, then again without the undiscounted
    ones of 1998: the parts of the second version, and whether their files are
    those of the first."""
    from tillstar.session import scratch_path
    from tillstar.sources import versions
    from tillstar.sources.tables import read_table
    lines = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_shipdate"])
    lines = lines.withColumn("year", F.year("l_shipdate"))
    root = scratch_path(spark, "versions")
    first = versions.load({"sales": lines}, root, {"sales": "year"})
    versions.load({"sales": lines.where("NOT (year = 1998 AND l_discount = 0)")}, root, {"sales": "year"})
    old = versions.manifest(spark, root, first).select("part", F.col("path").alias("old_path"))
    return (versions.manifest(spark, root).join(old, "part", "left")
            .select("part", "rows", F.coalesce(F.col("path") == F.col("old_path"), F.lit(False)).alias("kept")))


# ======================================================= matching / prices

@register("competitor_matches", "SELECT product_id, matched_name, match_score, competitor_price FROM matches")
def q_competitor_matches(spark, sf):
    from tillstar.operators import matching
    from tillstar.plans.star import competitor_catalogue, products_from_part
    from tillstar.sources.tables import read_table
    part = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    return matching.match_competitors(products_from_part(part), competitor_catalogue(part))


@register("competitor_price_stats", f"""
SELECT count(*) AS products, {M('avg(competitor_price)')} AS avg_price,
       min(competitor_price) AS min_price, max(competitor_price) AS max_price FROM catalogue""")
def q_competitor_price_stats(spark, sf):
    from tillstar.operators import extract
    from tillstar.plans.star import competitor_catalogue
    from tillstar.sources.tables import read_table
    part = read_table(spark, sf, "part", ["p_name", "p_retailprice"])
    return extract.price_stats(competitor_catalogue(part))


# ================================================================= text

_SCHEME = "'^([a-zA-Z][a-zA-Z0-9+.-]*:)'"
_HOST = "'^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)'"


def _url_join_sql(base: str, href: str) -> str:
    nf = f"regexp_replace({base}, '#.*$', '')"
    nq = f"regexp_replace({nf}, '\\?.*$', '')"
    pdir = (f"CASE WHEN regexp_matches({nq}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$') THEN {nq} || '/' "
            f"ELSE regexp_replace({nq}, '[^/]*$', '') END")
    return (f"CASE WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, {_SCHEME}, 1) || {href} "
            f"WHEN starts_with({href}, '/') THEN regexp_extract({base}, {_HOST}, 1) || {href} "
            f"WHEN starts_with({href}, '?') THEN {nq} || {href} "
            f"WHEN starts_with({href}, '#') THEN {nf} || {href} "
            f"WHEN {href} = '' THEN {base} "
            f"ELSE ({pdir}) || {href} END")


# anchors by cutting the page at "<a ": the first href of a piece, its text up to "</a>"
_ANCHORS_SQL = f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS position, href,
       trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS text,
       {_url_join_sql('url', 'href')} AS absolute_url
FROM (SELECT page_id, url, k, string_split(string_split(p, 'href="')[2], '"')[1] AS href,
             substr(string_split(p, '</a>')[1], strpos(p, '>') + 1) AS raw
      FROM (SELECT page_id, url, unnest(s[2:]) AS p, generate_subscripts(s[2:], 1) AS k
            FROM (SELECT page_id, url, string_split(html, '<a ') AS s FROM pages))
      WHERE contains(p, 'href="') AND contains(p, '</a>'))"""


@register("page_anchors", _ANCHORS_SQL)
def q_page_anchors(spark, sf):
    from tillstar.operators import extract
    from tillstar.sources.tables import read_table
    return extract.page_anchors(read_table(spark, sf, "pages", ["page_id", "url", "html"]))


@register("page_links", """
SELECT page_id, CAST(n - 1 AS INTEGER) AS position, CAST(n AS INTEGER) AS page_number,
       'https://shop.example.com/a/list?page=' || (page_id + n) AS page_url
FROM (SELECT DISTINCT CAST(floor(p_partkey / 12) AS BIGINT) AS page_id FROM part
      WHERE p_name IS NOT NULL AND p_retailprice IS NOT NULL), (VALUES (2), (3)) AS t(n)""")
def q_page_links(spark, sf):
    """Pages that list the parts: links by the way the pages are made."""
    from tillstar.operators import extract
    from tillstar.plans.star import listing_pages
    from tillstar.sources.tables import read_table
    return extract.page_links(listing_pages(read_table(spark, sf, "part", ["p_partkey", "p_name", "p_retailprice"])))


@register("navigation_links", """
SELECT page_id, count(*) AS links, count(DISTINCT absolute_url) AS targets FROM (
  SELECT page_id, """ + _url_join_sql("url", "href") + """ AS absolute_url FROM (
    SELECT page_id, url, string_split(string_split(p, 'href="')[2], '"')[1] AS href FROM (
      SELECT page_id, url, unnest(string_split(string_split(n, '</nav>')[1], '<a ')[2:]) AS p FROM (
        SELECT page_id, url, unnest(string_split(html, '<nav')[2:]) AS n FROM pages))
    WHERE contains(p, 'href="') AND contains(p, '</a>')))
GROUP BY page_id""")
def q_navigation_links(spark, sf):
    from tillstar.operators import extract
    from tillstar.sources.tables import read_table
    return extract.navigation_links(read_table(spark, sf, "pages", ["page_id", "url", "html"], spread=True))


@register("driver_page_links", "SELECT page_id, 0 AS position, 0 AS page_number, url AS page_url FROM pages "
                               "WHERE html ILIKE '%pagination%' OR html LIKE '%Previous%' OR html LIKE '%Next%'")
def q_driver_page_links(spark, sf):
    from tillstar.operators import extract
    from tillstar.sources.tables import read_table
    return extract.page_links(read_table(spark, sf, "pages", ["page_id", "url", "html"]))


@register("page_headings", """
SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS position,
       trim(regexp_replace(unnest(h), '<[^>]+>', '', 'g')) AS heading
FROM (SELECT page_id, regexp_extract_all(html, '<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)""")
def q_page_headings(spark, sf):
    from tillstar.operators import extract
    from tillstar.sources.tables import read_table
    return extract.page_headings(read_table(spark, sf, "pages", ["page_id", "html"]))


@register("competitor_listings", """
SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS page_id,
       CAST(row_number() OVER (PARTITION BY floor(p_partkey / 12) ORDER BY p_partkey) - 1 AS INTEGER) AS position,
       trim(p_name) AS competitor_product_name, floor(p_retailprice) AS competitor_price,
       'Ref: P-' || p_partkey AS product_reference, 'DZD' AS currency
FROM part WHERE p_name IS NOT NULL AND p_retailprice >= 1 AND p_partkey % 7 <> 0""")
def q_competitor_listings(spark, sf):
    """Pages that list the parts, read back: one listing for each priced part."""
    from tillstar.operators import extract
    from tillstar.plans.star import listing_pages
    from tillstar.sources.tables import read_table
    return extract.competitor_listings(listing_pages(
        read_table(spark, sf, "part", ["p_partkey", "p_name", "p_retailprice"])))


@register("driver_listings", "SELECT page_id FROM pages WHERE html LIKE '%DZD%'")
def q_driver_listings(spark, sf):
    """The pages table holds no listing; every page is searched."""
    from tillstar.operators import extract
    from tillstar.sources.tables import read_table
    return extract.competitor_listings(read_table(spark, sf, "pages", ["page_id", "html"], spread=True)).select("page_id")


_INVOICES: dict[tuple, DataFrame] = {}


def _invoices(spark, sf):
    """Parsed invoices, extracted once per session and written (the reports
    read the extract, as the modelled pipeline reads its saved invoice file)."""
    from tillstar.operators import extract
    from tillstar.plans.star import session_key
    from tillstar.session import materialize
    from tillstar.sources.tables import read_table
    from tillstar.plans.star import _LOCK
    key = session_key(spark, sf)
    with _LOCK:
        if key not in _INVOICES:
            docs = read_table(spark, sf, "documents", ["doc_id", "text"], spread=True, task_bytes=extract.INVOICE_TASK_BYTES)
            parsed = extract.parse_invoices(docs.withColumnRenamed("doc_id", "source_file"))
            _INVOICES[key] = materialize(parsed, "invoices")
    return _INVOICES[key]


@register("invoice_fields")
def q_invoice_fields(spark, sf):
    return _invoices(spark, sf)


@register("invoice_summary")
def q_invoice_summary(spark, sf):
    from tillstar.operators import extract
    return extract.invoice_summary(_invoices(spark, sf))


def _invoice_sql() -> str:
    from tillstar.operators import extract as X

    def q(s):
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(
        f"CASE WHEN NULLIF(regexp_extract(t, {q(p)}, 1), '') IS NOT NULL THEN "
        f"{q(tpl.split('{}')[0])} || regexp_extract(t, {q(p)}, 1) || {q(tpl.split('{}')[1])} END"
        for p, tpl in X.KNOWN_PRODUCTS)
    falsy = lambda c: f"({c} IS NULL OR {c} = 0)"
    return f"""
, inv0 AS (SELECT doc_id AS source_file, text AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
inv1 AS (
  SELECT source_file, t,
         list_filter(list_transform(string_split(t, chr(10)),
                                    lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')),
                     lambda l: l <> '') AS lines
  FROM inv0),
inv2 AS (
  SELECT *,
    list_filter(list_transform(lines, lambda l, i: {{'i': i, 'l': l}}),
                lambda s: regexp_matches(lower(s.l), {q(X.CLIENT_LINE_RE)})
                          AND regexp_matches(s.l, {q(X.CLIENT_ID_RE)}))[1] AS idl,
    list_filter(list_transform(lines, lambda l, i: {{'i': i, 'n': NULLIF(regexp_extract(l, {q(X.NAME_RE)}, 1), '')}}),
                lambda s: s.n IS NOT NULL AND NOT regexp_matches(s.n, {q(X.NAME_EXCLUDED_RE)}))[1] AS nb,
    list_filter(list_transform(lines, lambda l: {{
        'p': trim(regexp_extract(l, {q(X.PRODUCT_LINE_RE)}, 1)),
        'q': regexp_extract(l, {q(X.PRODUCT_LINE_RE)}, 2),
        'u': regexp_extract(l, {q(X.PRODUCT_LINE_RE)}, 3),
        't': regexp_extract(l, {q(X.PRODUCT_LINE_RE)}, 4),
        'm': regexp_matches(l, {q(X.PRODUCT_LINE_RE)})}}),
        lambda s: s.m AND NOT regexp_matches(s.p, {q(X.PRODUCT_HEADER_RE)}))[1] AS prod,
    list_filter(lines, lambda l: regexp_matches(l, {q(X.FALLBACK_NAME_RE)})
                                 AND NOT regexp_matches(l, {q(X.FALLBACK_NAME_EXCLUDED_RE)}))[1] AS name_fb,
    list_transform(regexp_extract_all(t, {q(X.NUMBER_RE)}, 1), lambda x: TRY_CAST(x AS BIGINT)) AS nums
  FROM inv1),
inv3 AS (
  SELECT source_file,
    NULLIF(regexp_extract(t, {q(X.DATE_RE)}, 1), '') AS date,
    NULLIF(regexp_extract(t, {q(X.ORDER_RE)}, 1), '') AS order_reference,
    coalesce(NULLIF(regexp_extract(idl.l, {q(X.CLIENT_ID_RE)}, 1), ''),
             NULLIF(regexp_extract(t, {q(X.FALLBACK_CLIENT_RE)}, 1), '')) AS customer_id,
    coalesce(CASE WHEN na IS NOT NULL AND (nb IS NULL OR idl.i <= nb.i) THEN trim(na) ELSE trim(nb.n) END,
             name_fb) AS customer_name,
    coalesce(NULLIF(prod.p, ''), {known}) AS product_name,
    CAST(NULLIF(prod.q, '') AS INTEGER) AS q0, CAST(NULLIF(prod.u, '') AS DOUBLE) AS u0,
    CAST(NULLIF(prod.t, '') AS DOUBLE) AS t0,
    list_filter(nums, lambda n: n BETWEEN {X.SMALL_RANGE[0]} AND {X.SMALL_RANGE[1]}) AS small,
    list_filter(nums, lambda n: n BETWEEN {X.LARGE_RANGE[0]} AND {X.LARGE_RANGE[1]}) AS large
  FROM (SELECT *, CASE WHEN contains(lower(lines[idl.i + 1]), 'nom')
                       THEN NULLIF(regexp_extract(lines[idl.i + 1], {q(X.NAME_RE)}, 1), '') END AS na
        FROM inv2)),
inv4 AS (
  SELECT *,
    CAST(CASE WHEN ({falsy('q0')} OR {falsy('t0')}) AND {falsy('q0')} AND len(small) > 0 THEN small[1]
              ELSE q0 END AS INTEGER) AS q1,
    CASE WHEN ({falsy('q0')} OR {falsy('t0')}) AND len(large) >= 2 AND {falsy('u0')}
         THEN CAST(large[1] AS DOUBLE) ELSE u0 END AS u1,
    CASE WHEN ({falsy('q0')} OR {falsy('t0')}) AND len(large) >= 2 AND {falsy('t0')} THEN CAST(large[2] AS DOUBLE)
         WHEN ({falsy('q0')} OR {falsy('t0')}) AND len(large) = 1 AND {falsy('t0')} THEN CAST(large[1] AS DOUBLE)
         ELSE t0 END AS t1
  FROM inv3),
inv5 AS (
  SELECT *, CASE WHEN NOT {falsy('q1')} AND NOT {falsy('u1')} AND {falsy('t1')} THEN q1 * u1 ELSE t1 END AS t2
  FROM inv4),
inv6 AS (
  SELECT *, CASE WHEN NOT {falsy('q1')} AND NOT {falsy('t2')} AND {falsy('u1')}
                 THEN t2 / CAST(q1 AS DOUBLE) ELSE u1 END AS u2
  FROM inv5),
invoices AS (
  SELECT source_file, date, order_reference, customer_id, customer_name, product_name,
    CASE WHEN NOT {falsy('q1')} AND NOT {falsy('u2')} AND NOT {falsy('t2')}
              AND abs(q1 * u2 - t2) > {X.TOTAL_TOLERANCE}
              AND round_even(t2 / u2, 0) BETWEEN {X.QTY_RANGE[0]} AND {X.QTY_RANGE[1]}
         THEN CAST(round_even(t2 / u2, 0) AS INTEGER) ELSE q1 END AS quantity,
    u2 AS unit_price, t2 AS total_revenue
  FROM inv6)
"""


ORACLE["invoice_fields"] = BASE + _invoice_sql() + "SELECT * FROM invoices"
ORACLE["invoice_summary"] = (BASE + _invoice_sql() + "SELECT count(*) AS invoices, "
                             + M("sum(CAST(total_revenue AS DECIMAL(18,2)))") + " AS total_revenue FROM invoices")


@register("marketing_spend", f"""
SELECT category, month_start AS month, CAST(spend_local AS DOUBLE) AS marketing_cost_local FROM spend""")
def q_marketing_spend(spark, sf):
    """Cleaned spend sheet (CLN1 + CLN4) aggregated per (category, month)."""
    return (_wh(spark, sf).table("marketing_spend")
            .select("category", "month",
                    F.col("marketing_cost_local").cast("double").alias("marketing_cost_local")))


_INVOICE_COLS = ("date", "order_reference", "customer_id", "customer_name", "product_name",
                 "quantity", "unit_price", "total_revenue")


def _invoice_completeness_sql() -> str:
    parts = []
    for i, c in enumerate(_INVOICE_COLS):
        pct = M(f"count({c}) * 100.0 / count(*)")
        parts.append(f"SELECT 'invoices' AS table_name, {i} AS position, '{c}' AS column_name, "
                     f"count({c}) AS filled, {pct} AS filled_pct, "
                     f"coalesce({pct}, 0.0) >= 80.0 AS complete FROM invoices")
    return " UNION ALL ".join(parts)


ORACLE["invoice_completeness"] = BASE + _invoice_sql() + _invoice_completeness_sql()


@register("invoice_completeness")
def q_invoice_completeness(spark, sf):
    """SNK5/DQ3: filled count and % per parsed invoice field (bar: 80 %)."""
    inv = _invoices(spark, sf).select(*_INVOICE_COLS)
    return DQ.completeness(inv, "invoices").withColumn("position", F.col("position").cast("int"))


# ===================================================== filtered dashboard
# The dashboard applies one filter to every report; these keys exercise it
# on more query shapes (window, HAVING, top-k, 4-dimension join).

STORE_FILTER = FL.SalesFilter(stores=("Supplier#000000001", "Supplier#000000002",
                                      "Supplier#000000003", "Supplier#000000005"),
                              subcategories=("Brand#1", "Brand#2", "Brand#3", "Brand#4"))
_STORE_WHERE = ("store_name IN ('Supplier#000000001', 'Supplier#000000002', "
                "'Supplier#000000003', 'Supplier#000000005') "
                "AND subcategory_name IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')")


@register("ytd_revenue_filtered", f"""
SELECT year, month, {M('_rev')} AS monthly_revenue,
       {M('sum(_rev) OVER (PARTITION BY year ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')}
         AS ytd_revenue
FROM (SELECT year, month, sum(total_revenue) AS _rev FROM star WHERE {_DEMO_WHERE} GROUP BY year, month)""")
def q_ytd_revenue_filtered(spark, sf):
    return MT.ytd_revenue(_wh(spark, sf).star, DEMO_FILTER)


@register("store_ranking_filtered",
          _STORE_RANKING_SQL.replace("WHERE monthly_target IS NOT NULL",
                                     f"WHERE monthly_target IS NOT NULL AND {_DEMO_WHERE}"))
def q_store_ranking_filtered(spark, sf):
    return MT.store_ranking(_wh(spark, sf).star, DEMO_FILTER)


@register("price_competitiveness_filtered", f"""
SELECT product_name, {M('_avg')} AS our_avg_price, competitor_price,
       {M('(_avg - competitor_price) * 100.0 / NULLIF(competitor_price, 0)')} AS price_diff_pct
FROM (SELECT product_id, product_name, competitor_price,
             CAST(sum({UNIT_PRICE}) AS DOUBLE) / count({UNIT_PRICE}) AS _avg
      FROM star WHERE competitor_price IS NOT NULL AND {_DEMO_WHERE}
      GROUP BY product_id, product_name, competitor_price HAVING count(*) >= 5)
ORDER BY price_diff_pct DESC NULLS LAST, product_id ASC LIMIT 10""")
def q_price_competitiveness_filtered(spark, sf):
    return MT.price_competitiveness(_wh(spark, sf).star, DEMO_FILTER)


@register("top_customers_filtered", f"""
SELECT customer_name, city_name, region, purchase_count, total_spent, avg_transaction_value,
       last_purchase_date FROM (
  SELECT customer_id, customer_name, customer_city AS city_name, customer_region AS region,
         count(*) AS purchase_count, {SUM('total_revenue')} AS total_spent,
         {AVG('total_revenue')} AS avg_transaction_value, max(full_date) AS last_purchase_date
  FROM star4 WHERE {_STORE_WHERE}
  GROUP BY customer_id, customer_name, customer_city, customer_region
  ORDER BY total_spent DESC NULLS LAST, customer_id ASC LIMIT 20)""")
def q_top_customers_filtered(spark, sf):
    return MT.top_customers(_wh(spark, sf).star, STORE_FILTER)


@register("regional_performance_filtered", f"""
SELECT store_region AS region, count(DISTINCT store_id) AS store_count, count(*) AS transactions,
       {SUM('total_revenue')} AS total_revenue, {SUM('net_profit')} AS net_profit,
       {AVG('total_revenue')} AS avg_transaction_value
FROM star WHERE {_STORE_WHERE} GROUP BY store_region""")
def q_regional_performance_filtered(spark, sf):
    return MT.regional_performance(_wh(spark, sf).star, STORE_FILTER)


@register("daily_sales_single_day", f"""
SELECT full_date, year, month_name, day_name, count(*) AS transactions,
       {SUM('total_revenue')} AS daily_revenue, {SUM('net_profit')} AS daily_profit
FROM star WHERE full_date = DATE '1998-06-15' GROUP BY full_date, year, month_name, day_name""")
def q_daily_sales_single_day(spark, sf):
    """FLT10: a single selected date means start = end."""
    return MT.daily_sales(_wh(spark, sf).star, FL.SalesFilter(date_range="1998-06-15"))


@register("competitor_matches_fuzzy")
def q_competitor_matches_fuzzy(spark, sf):
    """TXT2 fuzzy pass over the whole part table: no name matches exactly, so
    every product is scored against the catalogue (no SQL oracle: the string
    metric is not SQL; tests compare it with brute force on sf0.001)."""
    from tillstar.operators import matching
    from tillstar.plans.star import fuzzy_catalogue, products_from_part
    from tillstar.sources.tables import read_table
    part = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"],
                      spread=True)
    return matching.match_competitors(products_from_part(part), fuzzy_catalogue(part))


_COUNTED = ("dim_product", "dim_store", "dim_customer", "dim_date", "fact_sales", "marketing_roi")


@register("warehouse_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {'fact' if t == 'fact_sales' else t}"
    for t in _COUNTED))
def q_warehouse_row_counts(spark, sf):
    """ETL1/SRC11: rows per star table (parquet counts need no column data)."""
    wh = _wh(spark, sf)
    parts = [wh.table(t).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in _COUNTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ================================================= files, catalog, sinks

@register("csv_roundtrip", """
SELECT review_id, product_id, CAST(NULL AS VARCHAR) AS customer_id, CAST(rating AS VARCHAR) AS rating,
       nullif('"' || replace(review_text, chr(13), '') || '", he said', '') AS review_text FROM reviews""")
def q_csv_roundtrip(spark, sf):
    """SNK1, SRC1: the reviews, with quotes added and their line breaks kept,
    written as CSV and read back by the declared schema."""
    import os

    from tillstar.plans.star import reviews_from_documents
    from tillstar.session import scratch_path
    from tillstar.sources import files, sinks
    from tillstar.sources.tables import read_table
    docs = read_table(spark, sf, "documents", ["doc_id", "text"], spread=True)
    n = F.greatest(read_table(spark, sf, "part", ["p_partkey"]).agg(F.count(F.lit(1))).scalar(), F.lit(1))
    rows = reviews_from_documents(docs, n).select(
        "review_id", "product_id", F.lit(None).cast("string").alias("customer_id"),
        F.col("rating").cast("string").alias("rating"),
        F.concat(F.lit('"'), F.replace("review_text", F.lit("\r"), F.lit("")), F.lit('", he said')).alias("review_text"))
    root = scratch_path(spark, "csv")
    sinks.save_tables({"reviews": rows}, root)
    back = files.read_csv(spark, os.path.join(root, "reviews"), files.SCHEMAS["reviews"], enforce_schema=True)
    return back.withColumn("product_id", F.col("product_id").cast("long"))


@register("extraction_summary", """
SELECT 'table_nation' AS "table", count(*) AS rows, 3 AS columns, 'ok' AS status FROM nation
UNION ALL SELECT 'orders', count(*), 6, 'ok' FROM orders
UNION ALL SELECT 'broken', 0, 0, 'failed'
UNION ALL SELECT 'no_rows', 0, 4, 'ok'""")
def q_extraction_summary(spark, sf):
    """SRC6, SNK6: tables written one by one; one that can't be read is reported."""
    from tillstar.session import scratch_path
    from tillstar.sources import files
    from tillstar.sources.tables import read_table
    customer = read_table(spark, sf, "customer", ["c_custkey", "c_name"])
    return files.extract_tables({
        "table_nation": read_table(spark, sf, "nation"), "orders": read_table(spark, sf, "orders"),
        "broken": customer.select("c_custkey", F.raise_error(F.lit("unreadable")).alias("c_name")),
        "no_rows": read_table(spark, sf, "supplier").where("s_suppkey IS NULL")}, scratch_path(spark, "extract"))


@register("flat_files", f"""
SELECT 'marketing_expenses' AS sheet, count(*) AS rows, {M('sum(usd)')} AS amount FROM (SELECT DISTINCT * FROM mkt)
UNION ALL SELECT 'monthly_targets', count(*), {M('sum(CAST(s_acctbal AS DECIMAL(18,2)))')} FROM supplier WHERE s_acctbal > 0
UNION ALL SELECT 'shipping_rates', count(*), {M('sum(shipping_rate)')} FROM ship""")
def q_flat_files(spark, sf):
    """SNK1, SRC2, CLN1-3: the three sheets written as CSV, loaded and cleaned."""
    from tillstar.operators import clean
    from tillstar.plans.star import marketing_sheet, shipping_sheet, target_sheet
    from tillstar.session import scratch_path
    from tillstar.sources import files, sinks
    from tillstar.sources.tables import read_table
    totals = _wh(spark, sf).table("category_month_revenue")
    supplier = read_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    root = scratch_path(spark, "flat")
    sheets = {"marketing_expenses.csv": marketing_sheet(totals), "monthly_targets.csv": target_sheet(supplier),
              "shipping_rates.csv": shipping_sheet(spark)}
    sinks.save_tables(sheets, root)
    m, t, s = files.load_flat_files(spark, root)
    s = clean.clean_shipping(s).groupBy("region_name").agg(F.max("shipping_cost").alias("shipping_cost"))
    one = lambda df, name, c: df.agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("rows"),
                                     money(F.sum(F.col(c).cast("decimal(18,2)"))).alias("amount"))
    return (one(clean.clean_marketing(m), "marketing_expenses", "marketing_cost_usd")
            .unionByName(one(clean.clean_targets(t), "monthly_targets", "target_revenue"))
            .unionByName(one(s, "shipping_rates", "shipping_cost")))


_CATALOG = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _views(spark, sf):
    from tillstar.sources import catalog
    from tillstar.sources.tables import read_table
    catalog.register_views({f"t_{n}": read_table(spark, sf, n) for n in _CATALOG})
    return catalog


@register("table_list", " UNION ALL ".join(f"SELECT 't_{n}' AS name" for n in _CATALOG))
def q_table_list(spark, sf):
    """SRC9."""
    return _views(spark, sf).table_list(spark).where(F.col("name").isin(*(f"t_{n}" for n in _CATALOG)))


@register("table_info", " UNION ALL ".join(
    f"SELECT 't_{n}' AS table_name, column_name AS name, CAST(ordinal_position - 1 AS INTEGER) AS cid, "
    f"(SELECT count(*) FROM {n}) AS row_count FROM (SELECT column_name, ordinal_position "
    f"FROM (SELECT unnest(c) AS column_name, generate_subscripts(c, 1) AS ordinal_position "
    f"FROM (SELECT list(column_name ORDER BY column_index) AS c FROM duckdb_columns() WHERE table_name = '{n}')))"
    for n in _CATALOG))
def q_table_info(spark, sf):
    """SRC7, SRC10: structure and row count of each table."""
    cat, out = _views(spark, sf), None
    for n in _CATALOG:
        structure = cat.table_schema(spark, f"t_{n}")
        rows = cat.row_count(spark, f"t_{n}").scalar()
        df = structure.select(F.lit(f"t_{n}").alias("table_name"), "name", "cid", rows.alias("row_count"))
        out = df if out is None else out.unionByName(df)
    return out


@register("table_preview", "SELECT * FROM (SELECT c_custkey, c_name, c_nationkey FROM customer ORDER BY c_custkey LIMIT 100)")
def q_table_preview(spark, sf):
    """SRC12, SRC8: the first rows by key."""
    cat = _views(spark, sf)
    return cat.preview(spark, "t_customer", 100, ["c_custkey"]).select("c_custkey", "c_name", "c_nationkey")


@register("sql_parameters", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 40 AND o_orderdate >= DATE '1995-01-01'""")
def q_sql_parameters(spark, sf):
    """SRC8: values are bound, not pasted."""
    return _views(spark, sf).run_sql(
        spark, "SELECT o_orderkey, o_custkey FROM t_orders WHERE o_custkey BETWEEN :lo AND :hi "
               "AND o_orderdate >= CAST(:since AS DATE)", {"lo": 10, "hi": 40, "since": "1995-01-01"})


@register("etl_star", """
SELECT order_key * 8 + line_number AS sale_id, date_id, product_id, store_id, customer_id, quantity,
       CAST(total_revenue AS DECIMAL(18,4)) AS total_revenue, product_cost, shipping_cost, marketing_cost, net_profit
FROM fact""")
def q_etl_star(spark, sf):
    """ETL1, JN4, PRJ1-6: the driver tables written as extracted CSV files, read
    back by name, and the whole pipeline run over them; the fact by its contract."""
    num = lambda c: F.col(c).cast("long").alias(c)
    return _etl(spark, sf)["fact_sales"].select(
        "sale_id", "date_id", num("product_id"), num("store_id"), num("customer_id"), "quantity",
        F.col("total_revenue").cast("decimal(18,4)").alias("total_revenue"),
        *(F.col(c).cast("decimal(18,4)").alias(c) for c in ("product_cost", "shipping_cost", "marketing_cost", "net_profit")))


@register("etl_dimensions", """
SELECT 'product' AS kind, CAST(product_id AS VARCHAR) AS id, product_name AS name, subcategory_name AS part_of,
       category_name AS group_name, CAST(unit_price AS DOUBLE) AS first_amount, CAST(unit_cost AS DOUBLE) AS second_amount
FROM dim_product
UNION ALL SELECT 'store', CAST(store_id AS VARCHAR), store_name, city_name, region,
       CAST(monthly_target AS DOUBLE), CAST(annual_target AS DOUBLE) FROM dim_store
UNION ALL SELECT 'customer', CAST(customer_id AS VARCHAR), customer_name, city_name, region, NULL, NULL FROM dim_customer""")
def q_etl_dimensions(spark, sf):
    """ETL1, JN4, JN6, JN7, DIM1-3: the dimensions of the same run."""
    out, text = _etl(spark, sf), lambda c: F.col(c).cast("string")

    def rows(kind, df, key, name, part_of, group, *amounts):
        amounts = [F.col(a).cast("double") for a in amounts] or [F.lit(None).cast("double")] * 2
        return df.select(F.lit(kind).alias("kind"), text(key).alias("id"), text(name).alias("name"), text(part_of).alias("part_of"),
                         text(group).alias("group_name"), amounts[0].alias("first_amount"), amounts[1].alias("second_amount"))
    return (rows("product", out["dim_product"], "product_id", "product_name", "subcat_name", "category_name", "unit_price", "unit_cost")
            .unionByName(rows("store", out["dim_store"], "store_id", "store_name", "city_name", "region", "monthly_target", "annual_target"))
            .unionByName(rows("customer", out["dim_customer"], "customer_id", "full_name", "city_name", "region")))


@register("product_categories", """
SELECT 'subcategory' AS via, p_partkey AS product_id, lower(trim(p_type)) AS category FROM part
UNION ALL SELECT 'category_id', p_partkey, lower(trim(p_type)) FROM part
UNION ALL SELECT 'own_text', p_partkey, lower(trim(p_type)) FROM part
UNION ALL SELECT 'nothing', p_partkey, 'unknown' FROM part""")
def q_product_categories(spark, sf):
    """PRJ6: the category of each product by each of its four links: through the
    subcategory, by the product's category id, by its own text, or 'unknown'."""
    from tillstar.plans import etl
    from tillstar.sources.tables import read_table
    part = read_table(spark, sf, "part", ["p_partkey", "p_brand", "p_type"]).select(
        F.col("p_partkey").alias("product_id"), F.xxhash64("p_brand", "p_type").alias("sub_category_id"),
        F.pmod(F.hash("p_type"), F.lit(1 << 30)).alias("category_id"), F.concat(F.lit(" "), F.upper("p_type")).alias("Category"))
    subs = part.select("sub_category_id", "category_id").distinct()
    cats = part.select("category_id", F.col("Category").alias("category_name")).distinct()
    ways = {"subcategory": (part.select("product_id", "sub_category_id"), subs, cats),
            "category_id": (part.select("product_id", "category_id"), None, cats),
            "own_text": (part.select("product_id", "Category"), None, cats),
            "nothing": (part.select("product_id"), None, cats)}
    out = None
    for via, args in ways.items():
        df = etl.product_category(*args).select(F.lit(via).alias("via"), "product_id", "category")
        out = df if out is None else out.unionByName(df)
    return out


_ETL_RUNS: dict[tuple, dict[str, DataFrame]] = {}


def _etl(spark, sf) -> dict[str, DataFrame]:
    """The pipeline over extracted files, run and written once a session and input."""
    from tillstar.plans.star import session_key
    key = session_key(spark, sf)
    if key not in _ETL_RUNS:
        _ETL_RUNS[key] = _run_etl(spark, sf)
    return _ETL_RUNS[key]


def _run_etl(spark, sf) -> dict[str, DataFrame]:
    from tillstar.plans import etl
    from tillstar.plans import star as S
    from tillstar.session import delete, release, scratch_path
    from tillstar.sources import files, sinks
    from tillstar.sources.tables import read_table
    rd = lambda t: read_table(spark, sf, t)
    wh = _wh(spark, sf)
    part, docs = S.products_from_part(rd("part")), rd("documents")
    kinds = part.select(F.col("category_name")).distinct().withColumn(
        "category_id", F.pmod(F.hash("category_name"), F.lit(1 << 30)))
    prods = part.withColumn("subcat_id", F.col("product_id").cast("int"))
    sales = S.sales_from_orders(rd("lineitem"), rd("orders"))
    root = scratch_path(spark, "extracted")
    sinks.save_tables({f"{n}.csv": df for n, df in {
        "sales": sales.select((F.col("order_key") * 8 + F.col("line_number")).alias("Trans_ID"),
                              F.col("full_date").alias("Date"), F.col("store_id").alias("Store_ID"),
                              F.col("product_id").alias("Product_ID"), F.col("customer_id").alias("Customer_ID"),
                              F.col("quantity").alias("Quantity"), F.col("total_revenue").alias("Total Revenue")),
        "products": prods.select("product_id", "product_name", "subcat_id", "unit_price", "unit_cost"),
        "subcategories": prods.join(kinds, "category_name", "left").select(
            F.col("subcat_id").alias("Sub_Category_ID"), F.col("subcategory_name").alias("Sub_Category_Name"), "category_id"),
        "categories": kinds.select("category_id", "category_name"),
        "stores": rd("supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"),
                                        F.col("s_nationkey").alias("city_id")),
        "cities": S.geography(spark, sf).select(F.col("nationkey").alias("city_id"), "city_name",
                                                F.col("region").alias("Region_Name")),
        "customers": rd("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"),
                                           F.col("c_nationkey").alias("city_id")),
        "reviews": S.reviews_from_documents(docs.select("doc_id", "text"), F.greatest(
            rd("part").agg(F.count(F.lit(1))).scalar(), F.lit(1))).select("review_id", "product_id", "rating", "review_text"),
        "marketing_expenses": S.marketing_sheet(wh.table("category_month_revenue")),
        "monthly_targets": S.target_sheet(rd("supplier")),
        "shipping_rates": S.shipping_sheet(spark),
    }.items()}, root, compression="gzip")
    release(spark)
    extracted = files.read_extracted(spark, root)

    def spent(name):
        for folder in {f.rsplit("/", 1)[0] for f in extracted[name].inputFiles()}:     # its records
            delete(spark, folder)
        delete(spark, f"{root}/{name}.csv")
        release(spark)
    return etl.run_etl(extracted, write_to=scratch_path(spark, "etl"), spent=spent)


@register("profit_bands", f"""
SELECT CASE WHEN p >= 0 THEN 'profit' ELSE 'loss' END AS status, count(*) AS store_count, {M('sum(p)')} AS net_profit
FROM (SELECT store_id, sum(net_profit) AS p FROM star GROUP BY store_id) WHERE p IS NOT NULL GROUP BY 1""")
def q_profit_bands(spark, sf):
    """KPI2."""
    return SH.profit_bands(_wh(spark, sf).star)
