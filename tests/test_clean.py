"""Cleaning of the flat files (CLN1-CLN4) on literal dirty rows."""
import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from tillstar.operators import clean


def test_marketing_cleaning_and_aggregation(spark):
    raw = spark.createDataFrame([
        ("2024-01-15", " Laptops ", "100"),
        ("2024-01-15", " Laptops ", "100"),      # exact duplicate -> dropped
        ("2024-01-20", "LAPTOPS", "50.5"),       # second campaign, same month
        ("not a date", "phones", "10"),          # unparsable date -> NULL
        ("2024-02-01", "phones", "abc"),         # unparsable number -> 0
        ("2024-02-03", "phones", "-20"),         # negative -> 0
        ("2024-02-04", None, "5"),               # NULL category stays NULL
    ], "date string, category string, marketing_cost_usd string")
    m = clean.clean_marketing(raw)
    assert m.count() == 6
    got = rows(m, "category", "date", "marketing_cost_usd")
    assert (None, dt.date(2024, 2, 4), 5.0) in got
    assert ("phones", None, 10.0) in got
    assert ("phones", dt.date(2024, 2, 1), 0.0) in got
    assert ("phones", dt.date(2024, 2, 3), 0.0) in got
    local = clean.harmonize_currency(m)
    spend = rows(clean.spend_per_category_month(local), "category", "month", "marketing_cost_local")
    # 100 * 135 + 50.5 * 135 = 20317.50; NULL-keyed rows are dropped
    assert ("laptops", dt.date(2024, 1, 1), 20317.5) in [(a, b, float(c)) for a, b, c in spend]
    assert all(r[0] is not None and r[1] is not None for r in spend)


def test_targets_cleaning(spark):
    raw = spark.createDataFrame([
        ("2024-01", "Store_07", "1,200", "A"),
        ("2024-01", "store3", "2,500.50", "B"),
        ("2024-02", "4", "-5", None),
        ("bad", "x", "oops", "C"),
    ], "month string, store_id string, target_revenue string, manager_name string")
    got = rows(clean.clean_targets(raw), "store_id", "target_revenue", "month")
    assert got == [(3, 2500.5, dt.date(2024, 1, 1)), (4, 0.0, dt.date(2024, 2, 1)),
                   (7, 1200.0, dt.date(2024, 1, 1)), (None, 0.0, None)]


def test_shipping_cleaning_region_case(spark):
    raw = spark.createDataFrame([(" North ", "12.5"), ("north ", "x"), ("SOUTH", "-1")],
                                "region_name string, shipping_cost string")
    got = rows(clean.clean_shipping(raw), "region_name", "shipping_cost")
    assert got == [("north", 0.0), ("north", 12.5), ("south", 0.0)]
    # the join key of the dimension side is normalised the same way (D8)
    cities = spark.createDataFrame([("North",)], "region string")
    j = cities.join(clean.clean_shipping(raw), F.lower(F.trim("region")) == F.col("region_name"))
    assert j.count() == 2
