"""Driver tables: one parquet file (or folder) per table below ``sf_dir``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | tuple[str, ...] | None = None,
               spread: bool = False, key: str | None = None, task_bytes: int | None = None) -> DataFrame:
    """Read one driver table; selecting ``columns`` right away keeps the
    parquet ``ReadSchema`` to what the caller needs. ``spread`` applies
    :func:`ensure_parallelism` (for the large inputs of heavy jobs), by
    ``task_bytes`` of files a task if given."""
    df = spark.read.parquet(table_path(sf_dir, name))
    tasks = -(-_size(df) // task_bytes) if task_bytes else 0
    if columns:
        df = df.select(*columns)
    return ensure_parallelism(df, key, tasks) if spread else df


def _size(df: DataFrame) -> int:
    """Bytes of the files of a whole table, as the planner sees them; 0 if it doesn't say."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a Spark Connect session
        return 0


def ensure_parallelism(df: DataFrame, key: str | None = None, least: int = 0) -> DataFrame:
    """Rebalance when the scan yields fewer splits than the cluster has cores
    (e.g. one file with one row group). A large input already has at least as
    many splits and is returned unchanged, so this never adds a shuffle at
    scale. With ``key`` the rows are hash-partitioned on it, so a later
    grouping on that key reuses the partitioning; without, round-robin
    (which sorts rows first, so a retried task gets the same rows).

    Jobs of long work on each byte name a ``least`` number of tasks, so that the
    longest one doesn't grow with the input."""
    try:
        target = max(df.sparkSession.sparkContext.defaultParallelism, least)
        splits = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. a Spark Connect session): leave as is
        return df
    if splits < target:
        return df.repartition(target, key) if key else df.repartition(target)
    return df


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small literal table as a JVM-side local relation.

    Built from a pandas frame (Arrow), so scanning it never starts Python
    workers the way a list-backed frame (a Python RDD) does.
    """
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    pdf = pd.DataFrame(list(rows), columns=names, dtype=object) if rows else \
        pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
    return spark.createDataFrame(pdf, st)
