"""SNK2 by versions: a star that readers see old or new, never half written.

Each load writes its tables into a folder of its own. A table that is parted
(the fact, by year) is compared part by part with the version before: a part
with the same rows keeps its files, only the others are written. The manifest
(one row a part) names the folder of every part; the last step replaces the file
that names the manifest, in one rename. A reader takes the manifest it finds
first and reads those files; ``drop_unused`` deletes what no version named by
the caller needs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table_name string, part string, path string, rows long, digest decimal(38,0)"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _digest(df: DataFrame) -> list[F.Column]:
    """(rows, digest): equal for equal multisets of rows, whatever their order."""
    h = F.xxhash64(*(F.col(c) for c in sorted(df.columns)), *(F.col(c).isNull() for c in sorted(df.columns)))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest")]


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers see."""
    fs, p = _fs(spark, os.path.join(root, "CURRENT"))
    return spark.read.text(p.toString()).first()[0] if fs.exists(p) else None


def manifest(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """(table_name, part, path, rows, digest) of a version, the current one if none is given."""
    version = version or current(spark, root)
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(os.path.join(root, version, "_manifest"))


def load(tables: Mapping[str, DataFrame], root: str, parted: Mapping[str, str] | None = None,
         publish: bool = True) -> str:
    """Write a version and, with ``publish``, show it to readers. ``parted``: table
    -> column of its parts. Parts whose rows are those of the current version keep
    their files. Returns the version's name."""
    spark = next(iter(tables.values())).sparkSession
    version, old = f"v-{uuid.uuid4().hex}", manifest(spark, root)
    rows = []
    for name, df in tables.items():
        column, home = (parted or {}).get(name), os.path.join(root, version, name)
        before = {r.part: r for r in old.where(F.col("table_name") == name).collect()}      # one row a part
        part = F.coalesce(F.col(column).cast("string"), F.lit("null")) if column else F.lit("all")
        found = df.groupBy(part.alias("part")).agg(*_digest(df)).collect()                  # one row a part
        same = {r.part for r in found if r.part in before
                and (before[r.part].rows, before[r.part].digest) == (r.rows, r.digest)}
        new = [r for r in found if r.part not in same]
        if new:
            # every part has a folder, named apart from its value: the column stays in the files
            fresh = df if not same else df.where(~part.isin(*same))
            fresh.withColumn("_part", part).write.partitionBy("_part").parquet(home)
        rows += [(name, r.part, before[r.part].path if r.part in same else f"{home}/_part={r.part}", r.rows, r.digest)
                 for r in found]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(os.path.join(root, version, "_manifest"))
    if publish:
        show(spark, root, version)
    return version


def show(spark: SparkSession, root: str, version: str) -> None:
    """Point readers to a written version, by one rename over the old pointer."""
    fs, target = _fs(spark, os.path.join(root, "CURRENT"))
    _, fresh = _fs(spark, os.path.join(root, f"CURRENT-{uuid.uuid4().hex}"))
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, target, overwrite)


def read(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a version; the files of one version are never written again."""
    paths = [r.path for r in manifest(spark, root, version).where(F.col("table_name") == name).orderBy("part").collect()]
    if not paths:
        raise FileNotFoundError(f"{name}: no rows in the star at {root}")
    return spark.read.parquet(*paths)


def drop_unused(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Delete version folders that neither the current version nor one of ``keep``
    reads from; returns their names."""
    kept = {v for v in (current(spark, root), *keep) if v}
    used = set(kept)
    for v in kept:
        used |= {r.path[len(root):].strip("/").split("/")[0] for r in manifest(spark, root, v).select("path").collect()}
    fs, p = _fs(spark, root)
    gone = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("v-")
            and s.getPath().getName() not in used]
    for g in gone:
        fs.delete(g, True)
    return sorted(g.getName() for g in gone)
