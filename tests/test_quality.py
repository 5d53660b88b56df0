"""Quality checks (DQ1-DQ6, JN13) on literal frames."""
from helpers import rows
from tillstar.operators import quality


def test_duplicates_follow_pandas(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (None,)], "k long")
    assert quality.duplicate_keys(df, "k").first()[0] == 3   # one repeat of 1, two of NULL


def test_profile_and_completeness(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, None), (5, "y")],
                               "a long, b string")
    p = rows(quality.column_profile(df, "t"), "column_name", "non_null", "null_count", "null_pct")
    assert p == [("a", 5, 0, 0.0), ("b", 2, 3, 60.0)]
    c = rows(quality.completeness(df, "t"), "column_name", "filled_pct", "complete")
    assert c == [("a", 100.0, True), ("b", 40.0, False)]


def test_orphans_status_not_null(spark):
    fact = spark.createDataFrame([(1, 10), (2, 10), (3, 99), (3, None)], "pid long, sid long")
    dim = spark.createDataFrame([(1,), (2,)], "pid long")
    sdim = spark.createDataFrame([(10,)], "sid long")
    o = rows(quality.orphan_keys(fact, {"product": (dim, "pid", "pid"), "store": (sdim, "sid", "sid")}))
    assert o == [("product", 1), ("store", 1)]
    st = quality.table_status({"fact": (fact, ["pid"]), "dim": (dim, ["pid"])})
    got = {r["table_name"]: (r["rows"], r["missing_values"], r["duplicate_keys"], r["status"])
           for r in st.collect()}
    assert got == {"fact": (4, 1, 1, "WARNING"), "dim": (2, 0, 0, "OK")}
    nn = rows(quality.not_null_violations({"fact": (fact, ["pid", "sid"])}))
    assert nn == [("fact", "pid", 0), ("fact", "sid", 1)]


def test_stored_profile_equals_the_single_reports(spark):
    from tillstar.sources.tables import literal_table
    df = spark.createDataFrame([(1, "a", None), (1, None, 2.0), (None, "b", 3.0), (None, "b", None), (4, "c", 5.0)],
                               "id int, name string, v double")
    for t in (df, df.limit(0)):
        p = literal_table(spark, quality.profile(t, "t", ["id"]), quality.PROFILE)
        assert rows(quality.profile_columns(p)) == rows(quality.column_profile(t, "t"))
        assert rows(quality.profile_completeness(p)) == rows(quality.completeness(t, "t"))
        assert rows(quality.profile_duplicates(p), "duplicate_keys") == rows(quality.duplicate_keys(t, "id"))
        assert rows(quality.profile_status(p)) == rows(quality.table_status({"t": (t, ["id"])}))
