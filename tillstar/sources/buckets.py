"""Bucketed copies of tables that are joined again and again on one key.

Each bucket is one sorted file, so a join or an aggregation on the key needs no
exchange: the shuffle is paid once, when the copy is written, and not by every
rebuild. All tables of a set get the same number of buckets.

A key with more rows than an average bucket would make its bucket one long task,
and adaptive execution can't split a join that has no exchange. Such a table is
left as it was: the join then shuffles and its hot key is split at runtime.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.session import scratch_path

#: Bytes of the largest table's rows, as they are sorted in memory, in one bucket.
BUCKET_BYTES = 128 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in memory by its column types: a word each at least."""
    return sum(max(8, int(f.dataType().defaultSize())) for f in df._jdf.schema().fields())


def bucket_count(tables: list[DataFrame]) -> int:
    """A power of two: buckets of about BUCKET_BYTES, as many as there are cores at least.
    By the rows, not the files' size: compressed files hold several times as much."""
    size = max(t.count() * row_bytes(t) for t in tables)
    cores = tables[0].sparkSession.sparkContext.defaultParallelism
    return 1 << max(-(-size // BUCKET_BYTES), cores, 1).bit_length() - 1


def _name() -> str:
    return f"tillstar_bucketed_{uuid.uuid4().hex}"


def write(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` in ``buckets`` files by ``key``, each sorted by it."""
    name = _name()
    # the same hash as the buckets': each task writes one file
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", scratch_path(df.sparkSession, "bucketed")).saveAsTable(name))
    return df.sparkSession.table(name)


def path_of(df: DataFrame) -> str:
    """The folder of a table that :func:`write` made."""
    first = df.inputFiles()
    return first[0].rsplit("/", 1)[0] if first else ""


def attach(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A folder that :func:`write` filled, in a session whose catalog doesn't know it."""
    name = _name()
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet LOCATION '{path}' "
              f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS")
    return spark.table(name)


def hot(df: DataFrame, key: str, buckets: int) -> bool:
    """Whether one key has more rows than an average bucket (and 10,000 more).
    On a bucketed table the count by key needs no exchange."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    return (n["most"] or 0) > (n["all"] or 0) / buckets + 10_000


def colocated(tables: Mapping[str, tuple[DataFrame, str]], buckets: int | None = None) -> dict[str, DataFrame]:
    """Name -> bucketed copy of each (table, key); with a hot key in one of them
    all tables as they are."""
    buckets = buckets or bucket_count([df for df, _ in tables.values()])
    out = {}
    for name, (df, key) in tables.items():
        out[name] = write(df, key, buckets)
        if hot(out[name], key, buckets):
            return {n: t for n, (t, _) in tables.items()}
    return out
