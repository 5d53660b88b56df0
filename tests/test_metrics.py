"""Fact building invariants, ROI golden, filters, windows, shaping."""
import pytest
import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from tillstar.operators import facts, filters, metrics, shaping


def test_roi_golden(spark):
    # category-month with revenue 2,181,500 and spend 23,233.32 -> ROI 9,289.53
    fact = spark.createDataFrame([
        ("laptops", dt.date(2024, 1, 1), "1000000.00", "10000.00"),
        ("laptops", dt.date(2024, 1, 1), "1181500.00", "13233.32"),
        ("phones", dt.date(2024, 1, 1), "500.00", "0.00"),     # zero spend -> 0
        ("tv", dt.date(2024, 1, 1), "0.00", "0.00"),           # 0 / 0 -> NULL
    ], "category string, month_start date, total_revenue string, marketing_cost string")
    fact = fact.select("category", "month_start",
                       F.col("total_revenue").cast("decimal(18,4)").alias("total_revenue"),
                       F.col("marketing_cost").cast("decimal(18,4)").alias("marketing_cost"))
    got = rows(facts.marketing_roi_monthly(fact))
    assert got == [("laptops", "2024-01", 2181500.0, 23233.32, 9289.53),
                   ("phones", "2024-01", 500.0, 0.0, 0.0),
                   ("tv", "2024-01", 0.0, 0.0, None)]


def test_allocation_sums_to_spend(spark):
    sales = spark.createDataFrame([
        ("a", dt.date(2024, 1, 1), "10.0"), ("a", dt.date(2024, 1, 1), "30.0"),
        ("a", dt.date(2024, 2, 1), "5.0"), ("b", dt.date(2024, 1, 1), "7.0"),
    ], "category string, month date, total_revenue string").withColumn(
        "total_revenue", F.col("total_revenue").cast("decimal(18,4)"))
    spend = spark.createDataFrame([("a", dt.date(2024, 1, 1), "100.00"),
                                   ("a", dt.date(2024, 1, 1), "20.00")],
                                  "category string, month date, marketing_cost_local string") \
        .withColumn("marketing_cost_local", F.col("marketing_cost_local").cast("decimal(18,2)"))
    spend = spend.groupBy("category", "month").agg(F.sum("marketing_cost_local").alias("marketing_cost_local"))
    totals = facts.category_month_revenue(sales)
    cm = facts.bounded_broadcast(totals.join(spend, ["category", "month"], "left"))
    out = facts.allocate_marketing(sales, cm)
    per = {(r["category"], r["month"]): float(r["s"]) for r in
           out.groupBy("category", "month").agg(F.sum("marketing_cost").alias("s")).collect()}
    # two campaigns in one month are summed, not duplicated (D7); no spend -> 0
    assert per == {("a", dt.date(2024, 1, 1)): 120.0, ("a", dt.date(2024, 2, 1)): 0.0,
                   ("b", dt.date(2024, 1, 1)): 0.0}
    assert out.count() == 4


def _star(spark):
    data = [
        (dt.date(2023, 1, 5), "ASIA", "S1", "TOYS", "B1", 1, 10, "100.0", "10.0", 50.0, 0.5),
        (dt.date(2023, 2, 5), "ASIA", "S1", "TOYS", "B2", 2, 10, "200.0", "20.0", 50.0, -0.3),
        (dt.date(2023, 2, 6), "EUROPE", "S2", "GAMES", "B1", 3, 20, "300.0", "-30.0", None, None),
        (dt.date(2024, 1, 1), "EUROPE", "S2", "GAMES", "B3", 1, 20, "50.0", "5.0", None, 0.5),
    ]
    df = spark.createDataFrame(data, "full_date date, store_region string, store_name string, "
                                     "category_name string, subcategory_name string, quantity int, "
                                     "store_id long, total_revenue string, net_profit string, "
                                     "monthly_target double, sentiment_score double")
    return (df.withColumns({"total_revenue": F.col("total_revenue").cast("decimal(18,4)"),
                            "net_profit": F.col("net_profit").cast("decimal(18,4)"),
                            "annual_target": F.lit(None).cast("double"),
                            "year": F.year("full_date"), "month": F.month("full_date"),
                            "month_name": F.date_format("full_date", "MMMM")}))


def test_filter_semantics(spark):
    star = _star(spark)
    assert filters.SalesFilter().apply(star).count() == 4
    f = filters.SalesFilter(date_range=("2023-01-01", "2023-02-05"))
    assert f.apply(star).count() == 2                      # BETWEEN is inclusive
    assert filters.SalesFilter(date_range="2023-02-06").apply(star).count() == 1
    f = filters.SalesFilter(regions=("EUROPE",), categories=("GAMES",), subcategories=("B3",))
    assert f.apply(star).count() == 1
    assert filters.SalesFilter(stores=()).apply(star).count() == 4   # empty part skipped


def test_kpis_and_ytd(spark):
    star = _star(spark)
    k = metrics.kpi_target_achievement(star).first()
    # targets summed once per sale row: (50*12) * 2 rows = 1200; actual 650
    assert (k["actual_sales"], k["total_target"], k["achievement_percentage"]) == (650.0, 1200.0, 54.17)
    ps = metrics.kpi_target_achievement_per_store(star).first()
    assert ps["total_target"] == 600.0
    assert metrics.kpi_avg_sentiment(star).first()["avg_sentiment"] == 0.233
    ytd = rows(metrics.ytd_revenue(star), "year", "month", "monthly_revenue", "ytd_revenue")
    assert ytd == [(2023, 1, 100.0, 100.0), (2023, 2, 500.0, 600.0), (2024, 1, 50.0, 50.0)]
    share = shaping.share_of_total(metrics.category_performance(star).select(
        "category_name", "total_revenue"), "total_revenue")
    assert abs(sum(r["share_pct"] for r in share.collect()) - 100.0) < 0.02


def test_pivot_unpivot_bands(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)],
                               "k string, q int, v double")
    p = shaping.pivot(df, "k", "q", "v", [1, 2], prefix="q")
    assert rows(p, "k", "q1", "q2") == [("a", 1.0, 2.0), ("b", 3.0, None)]
    dup = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], "k string, q int, v double")
    with pytest.raises(Exception, match="duplicate"):
        shaping.pivot(dup, "k", "q", "v").collect()
    long = shaping.unpivot(p, ["k"], ["q1", "q2"])
    assert long.count() == 4
    s = spark.createDataFrame([(0.6,), (0.2,), (0.0,), (-0.1,), (-0.5,)], "s double")
    got = [r[0] for r in s.select(shaping.sentiment_band(F.col("s"))).collect()]
    assert got == ["Very Positive", "Positive", "Neutral", "Negative", "Very Negative"]
