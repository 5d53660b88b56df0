"""SNK3/DQ6 enforced: what a table must hold to be loaded (NOT NULL, primary key,
foreign keys), and the split of its rows into kept and set aside.

One pass over the table: NULLs and orphans are expressions (orphans after a
left join with a dimension's distinct keys), repeated keys are the rows behind
the first of their key, ranked among the rows that are fit otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """``references``: column -> (dimension frame, its key column); a NULL
    reference refers to nothing and is no orphan unless it is required."""

    required: Sequence[str] = ()
    key: Sequence[str] = ()
    references: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)


def reasons(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` with ``reason``: why a row must not be loaded, or NULL. Of the rows
    of one key the first by their values stays; a row with a NULL, an orphan or
    a NULL in its key never takes that place."""
    cols = [c for c in df.columns if c != "reason"]
    out = df.select(*cols)
    found = [F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in dict.fromkeys([*contract.key, *contract.required])]
    for n, (c, (dim, key)) in enumerate(contract.references.items()):
        known = dim.select(F.col(key).alias(f"_r{n}")).where(F.col(f"_r{n}").isNotNull()).distinct()
        out = out.join(known, F.col(c) == F.col(f"_r{n}"), "left")
        found.append(F.when(F.col(c).isNotNull() & F.col(f"_r{n}").isNull(), F.lit(f"orphan {c}")))
    out = out.select(*cols, F.coalesce(*found, F.lit(None).cast("string")).alias("_why"))
    if not contract.key:
        return out.withColumnRenamed("_why", "reason")
    # unfit rows have no rank among the fit ones, and are spread: a third of all keys may be NULL
    first = Window.partitionBy(*contract.key, F.when(F.col("_why").isNotNull(), F.xxhash64(*cols))).orderBy(*cols)
    return out.withColumn("_at", F.row_number().over(first)).select(
        *cols, F.coalesce("_why", F.when(F.col("_at") > 1, F.lit("duplicate key"))).alias("reason"))


def write_enforced(df: DataFrame, contract: Contract, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write ``df`` once, parted into what is kept and what is set aside:
    (kept rows, rows set aside with their ``reason``, counts by kind observed
    while writing)."""
    spark, seen = df.sparkSession, Observation("contract")
    judged = reasons(df, contract).withColumn("set_aside", F.col("reason").isNotNull())
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    judged = judged.observe(
        seen, F.count(F.lit(1)).alias("rows"), count(F.col("set_aside")).alias("set_aside"),
        *(count(F.coalesce(F.col("reason").startswith(k), F.lit(False))).alias(k) for k in ("null", "orphan", "duplicate")))
    judged.write.mode("overwrite").partitionBy("set_aside").parquet(path)
    back = spark.read.schema(judged.schema).parquet(path)
    kept = back.where("NOT set_aside").drop("set_aside", "reason")
    return kept, back.where("set_aside").drop("set_aside"), dict(seen.get)
