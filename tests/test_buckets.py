"""Bucketed copies: the same rows, and joins without an exchange."""
import random

import pytest

from helpers import rows
from tillstar.operators import metrics
from tillstar.plans import star
from tillstar.sources import buckets

SF = "/root/testdata/sf0.001"


@pytest.fixture
def merge_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pair(spark, n=500, hot=0):
    rng = random.Random(5)
    left = [(rng.choice([None, *range(60)]), i) for i in range(n)] + [(7, -i) for i in range(hot)]
    right = [(k, f"v{k}") for k in range(40)] + [(None, "none")]
    return (spark.createDataFrame(left, "k long, x long"), spark.createDataFrame(right, "j long, v string"))


def test_join_and_aggregation_without_exchange(spark, merge_joins):
    a, b = pair(spark)
    t = buckets.colocated({"a": (a, "k"), "b": (b, "j")}, 4)
    join = t["a"].join(t["b"], t["a"].k == t["b"].j)
    assert "Exchange" not in plan(join) and "Exchange" not in plan(join.groupBy("k").count())
    assert rows(join) == rows(a.join(b, a.k == b.j)) and rows(t["a"]) == rows(a)
    assert "Exchange" in plan(a.join(b, a.k == b.j))


def test_empty_and_hot_tables(spark, merge_joins):
    a, b = pair(spark)
    t = buckets.colocated({"a": (a.limit(0), "k"), "b": (b, "j")}, 4)
    assert rows(t["a"].join(t["b"], t["a"].k == t["b"].j)) == [] and rows(t["b"]) == rows(b)
    a, b = pair(spark, hot=15000)
    t = buckets.colocated({"a": (a, "k"), "b": (b, "j")}, 4)
    assert t["a"] is a and t["b"] is b


def test_attach(spark, merge_joins):
    a, b = pair(spark)
    t = buckets.write(a, "k", 4)
    again = buckets.attach(spark, buckets.path_of(t), "k long, x long", "k", 4)
    other = buckets.write(b, "j", 4)
    join = again.join(other, again.k == other.j)
    assert "Exchange" not in plan(join) and rows(join) == rows(a.join(b, a.k == b.j))


def test_bucket_count(spark):
    small = spark.range(10)
    cores = spark.sparkContext.defaultParallelism
    assert buckets.bucket_count([small]) == 1 << cores.bit_length() - 1
    big = spark.range(1 << 30)              # 8 bytes a row: 64 buckets
    assert buckets.bucket_count([small, big]) == 64


def test_star_inputs(spark, merge_joins):
    plain = star.sales_from_orders(**star.order_tables(spark, SF))
    sales = star.sales_from_orders(**star.order_tables(spark, SF, bucketed=True))
    assert "Exchange" not in plan(sales) and "Exchange" in plan(plain)
    assert rows(sales) == rows(plain)
    # a build from now on joins the copies
    assert "Exchange" not in plan(star.sales_from_orders(**star.order_tables(spark, SF)))
    # of the report over orders only its last, small aggregation shuffles
    assert plan(metrics.basket_sizes(sales)).count("Exchange") == 1


def test_buckets_by_rows_not_by_compressed_files(spark, tmp_path):
    # equal rows compress to almost nothing; sorted in memory they take 8 bytes a column
    n = 8 << 20
    df = spark.range(n).selectExpr("id % 3 AS k", "1L AS a", "2L AS b", "3L AS c")
    df.write.parquet(str(tmp_path / "flat"))
    got = buckets.bucket_count([spark.read.parquet(str(tmp_path / "flat"))] * 2)
    cores = spark.sparkContext.defaultParallelism
    assert got >= n * 32 // buckets.BUCKET_BYTES and got >= cores
    old, buckets.BUCKET_BYTES = buckets.BUCKET_BYTES, 1 << 20
    try:
        assert buckets.bucket_count([spark.read.parquet(str(tmp_path / "flat"))]) == 256
    finally:
        buckets.BUCKET_BYTES = old
