"""Session defaults, lineage cuts and shared scratch locations.

Everything here is cluster-safe: intermediate tables go to the folder the
cluster names in ``spark.checkpoint.dir`` (a shared file system), never to a
machine-local temporary folder.  Only when the session has no checkpoint
folder at all (unit tests, a laptop) do we pick one ourselves.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast a table only when its size in bytes is proven below this bound.  A
# session can set its own with ``spark.prefscan.broadcastBytes``.
BROADCAST_BYTES = 64 << 20
BROADCAST_BYTES_CONF = "spark.prefscan.broadcastBytes"


def broadcast_bytes(spark: SparkSession) -> int:
    value = spark.conf.get(BROADCAST_BYTES_CONF, None)
    return int(value) if value else BROADCAST_BYTES


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted up to the bound, fit it
    at ``row_bytes`` each; otherwise unchanged (Spark then shuffles)."""
    most = broadcast_bytes(df.sparkSession) // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "prefscan") -> SparkSession:
    """A session with the defaults this library is tuned for.

    AQE re-plans joins at run time (broadcast when a side turns out small,
    coalesces tiny shuffle partitions and splits skewed ones).
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # checkpoint files are removed once nothing references them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from the SparkContext or ``spark.checkpoint.dir``; only when both are
    unset (tests, local runs) a private folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach "
                               "(a shared file system); prefscan writes lineage cuts there")
        # single machine (tests, a laptop): the driver's disk is the shared disk
        conf = tempfile.mkdtemp(prefix="prefscan-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables.
    They live as long as the session's results may need them and are deleted
    when the Python driver exits."""
    path = os.path.join(checkpoint_dir(spark), "prefscan-tables", f"{name}-{uuid.uuid4().hex[:12]}")
    if not _SCRATCH:
        atexit.register(_delete_scratch)
    _SCRATCH.append(path)
    return path


def _delete_scratch() -> None:
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    for path in _SCRATCH:
        with contextlib.suppress(Py4JError):  # the JVM may be gone already
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


# Row groups small enough that one task's file is read by several tasks.
ROW_GROUP = 4 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage as a
    checkpoint does, and later passes read only the columns they use, split at
    row groups however few tasks wrote them."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used where later jobs must see exactly the same rows (partition ids,
    sampled range bounds) even if executors are lost and stages re-run.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
