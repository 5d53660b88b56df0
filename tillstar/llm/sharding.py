"""Sharding by jump consistent hashing.

A row's shard follows from its stable key and the number of shards alone: no
ring table, no state. With one shard more, about 1/(n+1) of the keys move, all
of them into the new shard.

Null keys count as key 0. Equal keys share a shard and get slots of their own.
Null texts have no bytes. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARDS = 40
ROW_OVERHEAD = 16
#: Most pieces a shard is cut into for numbering its rows.
MAX_PIECES = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys jump in step."""
    key = keys.astype(np.uint64)
    b = np.zeros(len(key), np.int64)
    j = np.zeros(len(key), np.float64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live].astype(np.int64)
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = np.floor((b[live] + 1) * (2.0 ** 31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)))
        live = live[j[live] < shards]
    return b


def shard_of(key, shards: int):
    """Column of the shard of a long key."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))
    return jump(F.coalesce(key.cast("long"), F.lit(0)))


def assign(df: DataFrame, key: str, shards: int, order: list[str]) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``grown_shard`` (the shard with one shard more).

    A shard's rows are numbered in pieces: a row's slot is the count of the
    shard's earlier pieces plus its rank in its own piece, so that no shard is
    ever one group. ``order`` must tell rows apart that aren't equal."""
    spark = df.sparkSession
    pieces = min(MAX_PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    piece = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(pieces)).cast("int")
    out = (df.withColumn("shard", shard_of(F.col(key), shards))
           .withColumn("grown_shard", shard_of(F.col(key), shards + 1))
           .withColumn("_piece", piece))
    start = F.sum("_n").over(W.partitionBy("shard").orderBy("_piece")) - F.col("_n")
    starts = (df.select(shard_of(F.col(key), shards).alias("shard"), piece.alias("_piece"))
              .groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
              .select("shard", "_piece", start.alias("_start")))
    rank = F.row_number().over(W.partitionBy("shard", "_piece").orderBy(*order))
    # at most shards x MAX_PIECES rows: bounded whatever the input
    return (out.withColumn("_rank", rank - 1).join(F.broadcast(starts), ["shard", "_piece"])
            .withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long"))
            .drop("_piece", "_start", "_rank"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(docs, "doc_id", SHARDS, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
