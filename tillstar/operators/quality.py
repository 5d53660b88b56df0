"""Data-quality checks (DQ1-DQ6) and referential integrity (JN13).

Each check is one aggregate pass (or one anti join) per table; results are
small DataFrames, unioned per table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillstar.functions.money import money

OK_MISSING_PCT = 5.0
COMPLETE_PCT = 80.0


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """DQ1: per column non-NULL count, NULL count and NULL % (one pass)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.col(f"nn_{i}").alias("non_null"))
        for i, c in enumerate(cols)]))
    return (row.select("_rows", stack.alias("s"))
            .select(F.lit(table).alias("table_name"), "s.position", "s.column_name",
                    "s.dtype", "s.non_null",
                    (F.col("_rows") - F.col("s.non_null")).alias("null_count"),
                    money(F.try_divide((F.col("_rows") - F.col("s.non_null")) * 100.0,
                                       F.col("_rows").cast("double"))).alias("null_pct")))


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """DQ2: rows whose key repeats an earlier row's key (pandas ``duplicated``:
    repeated NULL keys count as duplicates too)."""
    keys = [key] if isinstance(key, str) else list(key)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_keys"))


def completeness(df: DataFrame, table: str, threshold: float = COMPLETE_PCT) -> DataFrame:
    """DQ3: per column filled count, filled % and whether it reaches the bar."""
    p = column_profile(df, table)
    pct = money(F.try_divide(F.col("non_null") * 100.0,
                             (F.col("non_null") + F.col("null_count")).cast("double")))
    return p.select("table_name", "position", "column_name",
                    F.col("non_null").alias("filled"), pct.alias("filled_pct"),
                    (F.coalesce(pct, F.lit(0.0)) >= threshold).alias("complete"))


def orphan_keys(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """DQ4/JN13: per dimension, distinct fact keys missing from it.

    ``dims``: name -> (dimension frame, fact key column, dimension key column).
    Distinct keys are taken first (partial aggregation), then a left-anti join.
    """
    out = []
    for name, (dim, fkey, dkey) in dims.items():
        fk = fact.select(F.col(fkey).alias("_k")).where(F.col("_k").isNotNull()).distinct()
        dk = dim.select(F.col(dkey).alias("_k"))
        n = fk.join(dk, "_k", "left_anti").agg(F.count(F.lit(1)).alias("orphan_keys"))
        out.append(n.select(F.lit(name).alias("dimension"), "orphan_keys"))
    return _union(out)


def table_status(tables: Mapping[str, tuple[DataFrame, Sequence[str] | None]]) -> DataFrame:
    """DQ5: rows, columns, missing cells and %, duplicate keys, OK/WARNING."""
    out = []
    for name, (df, key) in tables.items():
        cols = df.columns
        miss = reduce(lambda a, b: a + b,
                      [F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in cols])
        base = df.agg(F.count(F.lit(1)).alias("rows"), miss.alias("missing_values"))
        dups = duplicate_keys(df, key).scalar() if key else F.lit(0).cast("long")
        row = base.withColumn("duplicate_keys", dups)
        pct = money(F.try_divide(F.col("missing_values") * 100.0,
                                 (F.col("rows") * len(cols)).cast("double")))
        out.append(row.select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(cols)).alias("columns"),
            F.coalesce("missing_values", F.lit(0)).cast("long").alias("missing_values"),
            F.coalesce(pct, F.lit(0.0)).alias("missing_pct"), "duplicate_keys",
            F.when((F.coalesce(pct, F.lit(0.0)) < OK_MISSING_PCT) & (F.col("duplicate_keys") == 0),
                   "OK").otherwise("WARNING").alias("status")))
    return _union(out)


def not_null_violations(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """DQ6: NULL count per required (NOT NULL / key) column."""
    out = []
    for name, (df, cols) in tables.items():
        row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"v_{i}")
                       for i, c in enumerate(cols)])
        stack = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"),
                     F.coalesce(F.col(f"v_{i}"), F.lit(0)).cast("long").alias("violations"))
            for i, c in enumerate(cols)]))
        out.append(row.select(stack.alias("s")).select(
            F.lit(name).alias("table_name"), "s.column_name", "s.violations"))
    return _union(out)


# ------------------------------------------------------------ stored profile

PROFILE = ("table_name string, position int, column_name string, dtype string, rows long, non_null long, "
           "duplicate_keys long")


def profile(df: DataFrame, table: str, key: Sequence[str]) -> list[tuple]:
    """The rows of PROFILE for a table, from one scan of it: what each column
    holds is observed while the rows pass on to the count of repeated keys, which
    shuffles the key alone."""
    cols, seen = df.columns, Observation(f"profile {table}")
    types = [f.dataType.simpleString() for f in df.schema]
    if df.isEmpty():
        return [(table, i, c, t, 0, 0, 0) for i, (c, t) in enumerate(zip(cols, types))]
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(cols)))
    repeated = duplicate_keys(counted, key).first()[0]
    got = seen.get
    return [(table, i, c, t, got["rows"], got[f"nn_{i}"], repeated) for i, (c, t) in enumerate(zip(cols, types))]


def _filled_pct(of: str, rows: str = "rows"):
    return money(F.try_divide(F.col(of) * 100.0, F.col(rows).cast("double")))


def profile_columns(p: DataFrame) -> DataFrame:
    """DQ1 from a stored profile."""
    return (p.withColumn("null_count", F.col("rows") - F.col("non_null"))
            .select("table_name", "position", "column_name", "dtype", "non_null", "null_count",
                    _filled_pct("null_count").alias("null_pct")))


def profile_duplicates(p: DataFrame) -> DataFrame:
    """DQ2 from a stored profile."""
    return p.where("position = 0").select("table_name", "duplicate_keys")


def profile_completeness(p: DataFrame, threshold: float = COMPLETE_PCT) -> DataFrame:
    """DQ3 from a stored profile."""
    pct = _filled_pct("non_null")
    return p.select("table_name", "position", "column_name", F.col("non_null").alias("filled"), pct.alias("filled_pct"),
                    (F.coalesce(pct, F.lit(0.0)) >= threshold).alias("complete"))


def profile_status(p: DataFrame) -> DataFrame:
    """DQ5 from a stored profile."""
    t = p.groupBy("table_name", "rows", "duplicate_keys").agg(
        F.count(F.lit(1)).alias("columns"), F.sum(F.col("rows") - F.col("non_null")).alias("missing_values"))
    t = t.withColumn("cells", F.col("rows") * F.col("columns"))
    pct = F.coalesce(_filled_pct("missing_values", "cells"), F.lit(0.0))
    return t.select("table_name", "rows", F.col("columns").cast("int").alias("columns"), "missing_values",
                    pct.alias("missing_pct"), "duplicate_keys",
                    F.when((pct < OK_MISSING_PCT) & (F.col("duplicate_keys") == 0), "OK").otherwise("WARNING").alias("status"))
