"""Reading, scratch tables and connected components for the corpus operators."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.session import scratch_path, ship_package
from tillstar.sources.tables import read_table

#: Rows in an Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = 1000
#: Seconds that listeners get for the end of a step.
SETTLE_S = 0.5


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    prepare(spark)
    return read_table(spark, sf_dir, name, cols or None, spread=True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: computed
    once, and a lost executor re-reads it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_large(df: DataFrame, name: str) -> DataFrame:
    """:func:`cut` for large shuffles: Spark deletes their files when the driver
    collects its garbage, which may be long after the step; here it is at once,
    when the listeners have dealt with the step's end and let go of its plan."""
    out = cut(df, name)
    del df
    time.sleep(SETTLE_S)
    try:
        out.sparkSession.sparkContext._jvm.System.gc()
    except Exception:  # Spark Connect: no JVM on the client
        pass
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote; nothing may read it any more."""
    sc = df.sparkSession.sparkContext
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def recount(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, if it has that column, counted anew."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(run, schema)


#: Words of 64 bits in the sketch of :func:`probably_in`.
SKETCH_WORDS = 1 << 17


def probably_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose ``key`` (long) isn't in ``ids`` (one
    column): a Bloom filter of SKETCH_WORDS words, built on the cluster and
    broadcast, spares them the shuffle of the exact join that must follow. A
    full filter lets everything pass."""
    def place(c):
        h = F.xxhash64(c)
        return F.pmod(h, F.lit(SKETCH_WORDS)).cast("int"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")
    slot, bit = place(F.col(ids.columns[0]))
    words = (ids.select(slot.alias("_w_slot"), F.expr("1L").alias("_w_one"), bit.alias("_w_bit"))
             .groupBy("_w_slot").agg(F.expr("bit_or(shiftleft(_w_one, _w_bit))").alias("_w_word")))
    slot, bit = place(F.col(key))
    # at most SKETCH_WORDS rows of 12 bytes, whatever the input
    return (df.withColumn("_w_slot", slot).withColumn("_w_bit", bit).join(F.broadcast(words), "_w_slot")
            .where(F.expr("getbit(_w_word, _w_bit) = 1")).select(*df.columns))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected ``edges`` (``a`` long, ``b``
    long): (node, root), root the least node reachable; only nodes with an edge.
    Alternating large and small stars; each step is an aggregation with map-side
    combine and a join that adaptive execution can split, so that a hub is never
    one group. Done when all edges are stars: each node has one edge to a root."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .where("a <> b").distinct(), name)
    while True:
        ends = (e.select("a", F.lit(1).alias("up"), F.lit(0).alias("root"))
                .unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("root")))
                .groupBy("a").agg(F.sum("up").alias("up"), F.max("root").alias("root")))
        if ends.where("up > 1 OR up > 0 AND root > 0").isEmpty():
            break
        sides = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (sides.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
    return (e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
