"""The mergeable aggregate answers as the fact does."""
import datetime as dt
import random

import pytest

from helpers import rows
from tillstar.operators import cube, metrics
from tillstar.operators.filters import SalesFilter

SCHEMA = ("full_date date, year int, month int, month_name string, store_region string, store_name string, "
          "category_name string, subcategory_name string, total_revenue decimal(18,4), net_profit decimal(18,4), "
          "quantity int, annual_target double, monthly_target double, sentiment_score double, "
          "customer_id long, product_id long, store_id long")
FILTERS = (None, SalesFilter(), SalesFilter(date_range=("2024-01-15", "2024-03-01")), SalesFilter(regions=("EAST",)),
           SalesFilter(categories=("a", "b"), subcategories=("s1",)), SalesFilter(date_range="1999-01-01"))


def sales(n, seed):
    from decimal import Decimal
    rng, out = random.Random(seed), []
    for _ in range(n):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(90))
        maybe = lambda x: None if rng.random() < .1 else x
        out.append((d, d.year, d.month, d.strftime("%B"), maybe(rng.choice(["EAST", "WEST"])), rng.choice("xyz"),
                    maybe(rng.choice("abc")), maybe(rng.choice(["s1", "s2"])),
                    maybe(Decimal(rng.randrange(10**7)).scaleb(-4)), maybe(Decimal(rng.randrange(-10**6, 10**6)).scaleb(-4)),
                    maybe(rng.randrange(9)), maybe(1000.5), maybe(90.25), maybe(rng.uniform(-1, 1)),
                    maybe(rng.randrange(20)), rng.randrange(15), rng.randrange(4)))
    return out


@pytest.fixture(scope="module")
def star(spark):
    return spark.createDataFrame(sales(400, 1), SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([(1, .25), (2, None), (3, -.5)], "product_id long, avg_sentiment double")


@pytest.mark.parametrize("flt", FILTERS, ids=str)
def test_equals_the_fact(star, products, flt):
    c = cube.build(star)
    assert cube.covers(flt)
    assert rows(cube.kpi_bundle(c, products, flt)) == rows(metrics.kpi_bundle(star, products, flt))
    assert rows(cube.monthly_trends(c, flt)) == rows(metrics.monthly_trends(star, flt))


def test_summary_equals_the_fact(spark, star):
    for s in (star, star.limit(0)):
        want = metrics.dashboard_summary(s)
        assert rows(cube.dashboard_summary(cube.build(s), cube.distinct_ids(s)), *want.columns) == rows(want)


def test_parts_merge(star):
    early, late = star.where("month = 1"), star.where("month > 1")
    whole = cube.build(star)
    merged = cube.merge(cube.build(early), cube.build(late), cube.build(star.limit(0)))
    assert merged.dtypes == whole.dtypes and rows(merged) == rows(whole)


def test_a_store_filter_is_finer():
    assert not cube.covers(SalesFilter(stores=("x",)))
