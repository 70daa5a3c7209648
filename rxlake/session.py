"""Spark session helpers.

The library never creates a session behind the caller's back: jobs take a
``SparkSession``.  ``get_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on.  ANSI stays on (Spark 4 default): bad casts
# are written as try_cast on purpose.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # cp949 / MS949 catalogue files (S1) need the legacy charset list.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of DataFrames that are gone are deleted, so the
    # shared checkpoint folder does not grow for the life of the session
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "rxlake",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only when it is unset (local tests) do we pick a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rxlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():   # one subfolder a session
        spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_rxlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # the driver's file server reads it from here as executors come and go
    archive = os.path.join(tempfile.mkdtemp(prefix="rxlake-code-"), "rxlake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._rxlake_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count; a non-numeric setting (some
    platforms allow ``auto``) falls back to the cluster's core count."""
    v = spark.conf.get("spark.sql.shuffle.partitions", None)
    try:
        return max(1, int(v))
    except (TypeError, ValueError):
        return max(1, spark.sparkContext.defaultParallelism)
