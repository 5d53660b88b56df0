"""Session helpers: builder defaults, checkpoint/warehouse folder resolution."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import SparkSession

# Session settings the engine relies on. AQE re-plans joins at runtime (turns a
# sort-merge join into a broadcast join when the real side is small, splits
# skewed partitions, coalesces tiny shuffle partitions).
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app_name: str = "tillstar",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or get) a session with the engine defaults.

    On a cluster ``master`` is left to spark-submit; locally pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(ENGINE_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable engine settings to an existing session."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on an already running session
            pass


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that
    Python workers can import it whatever folder the driver started in."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    app = sc.applicationId if sc is not None else id(spark)
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tillstar-pkg-")  # the driver serves it as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "tillstar_package.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("tillstar", os.path.relpath(full, root)))
    if sc is None:
        spark.addArtifacts(name, pyfile=True)
    else:
        sc.addPyFile(name)
    _SHIPPED.add(app)


_SHIPPED: set = set()


def _is_local(spark: SparkSession) -> bool:
    """One JVM does all the work, so that its own disk is shared."""
    try:
        return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None
    except Exception:
        return False


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` or what
    the session set with ``setCheckpointDir``. Only a local session that has
    neither gets a scratch folder of its own; on a cluster that is an error."""
    global _LOCAL_CKPT
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    d = sc.getCheckpointDir() if sc is not None else None
    if d:  # Spark appends a folder of its own to what was set
        return d
    if sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _LOCAL_CKPT is None:
            _LOCAL_CKPT = tempfile.mkdtemp(prefix="tillstar-ckpt-")
            atexit.register(shutil.rmtree, _LOCAL_CKPT, ignore_errors=True)
        d = _LOCAL_CKPT
    if sc is not None:
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


_LOCAL_CKPT: str | None = None


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique sub-path below the checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tillstar", *parts, uuid.uuid4().hex)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what the engine wrote below the checkpoint folder. Frames that read
    it are lost; call it when a session's results have been saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint_dir(spark), "tillstar"))
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that the engine wrote; nothing may read it any more."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm, True)


def release(spark: SparkSession, settle_s: float = 0.5) -> None:
    """Let Spark delete the shuffle files of finished steps now and not when the
    driver happens to collect its garbage."""
    time.sleep(settle_s)                # the listeners let go of the last step's plan
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # Spark Connect: no JVM on the client
        pass


def materialize(df, name: str = "tmp"):
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts
    the lineage and lets several later passes reuse the computed rows (a lost
    executor then re-reads them instead of recomputing the whole plan)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
