"""Catalog helpers over a session's tables and views (SRC7-SRC12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.sources.tables import literal_table


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_list(spark: SparkSession) -> DataFrame:
    """SRC9: table and view names, sorted."""
    names = sorted(t.name for t in spark.catalog.listTables())
    return literal_table(spark, [(n,) for n in names], "name string")


def table_schema(spark: SparkSession, table: str) -> DataFrame:
    """SRC10: (cid, name, type, notnull, dflt_value, pk) per column."""
    df = spark.table(table)
    rows = [(i, f.name, f.dataType.simpleString(), not f.nullable, None, False)
            for i, f in enumerate(df.schema.fields)]
    return literal_table(
        spark, rows, "cid int, name string, type string, notnull boolean, dflt_value string, pk boolean")


def row_count(spark: SparkSession, table: str) -> DataFrame:
    """SRC11: one-row count."""
    return spark.table(table).agg(F.count(F.lit(1)).alias("count"))


def table_info(spark: SparkSession, table: str) -> tuple[int, DataFrame]:
    """SRC7: (row count, structure)."""
    return spark.table(table).count(), table_schema(spark, table)


def preview(spark: SparkSession, table: str, limit: int = 100,
            order_by: Sequence[str] | None = None) -> DataFrame:
    """SRC12/SNK7: the first ``limit`` rows (ordered when keys are given, so
    the preview is deterministic)."""
    df = spark.table(table)
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(limit)


def run_sql(spark: SparkSession, query: str, params: Sequence | Mapping | None = None) -> DataFrame:
    """SRC8: parameterised SQL; values are bound, never pasted into the text
    (positional ``?`` with a sequence, ``:name`` with a mapping)."""
    if params is None:
        return spark.sql(query)
    return spark.sql(query, args=params)
