"""Session helpers: a local session for tests and the shared scratch folder.

Library code never creates its own session; it takes the caller's.  Written
tables go to the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "simpairs") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Broadcast only what was measured: no plan-time estimate broadcasts,
        # AQE converts a join once the smaller side's real size is known.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at storage that the driver and all
    executors share; without it this raises.  On a local master (tests, bench)
    a private folder is created and registered once per session.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # The setting itself is fixed once a session runs; the context keeps the folder.
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="simpairs-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, in whatever store Spark writes to; none if it is not there."""
    target, fs = _hadoop(spark, path)
    if not fs.exists(target):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(target))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a table that this library wrote and nothing reads any more."""
    target, fs = _hadoop(spark, path)
    fs.delete(target, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the checkpoint root for written tables."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows that one task of a shuffle is to hold.
ROWS_PER_TASK = 1_000_000


@contextlib.contextmanager
def shuffles_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside shuffles ``rows`` rows into enough partitions, and at
    least the session's number."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), -(-rows // ROWS_PER_TASK))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver
    found it: its sources go out once per application with ``addPyFile``."""
    sc = spark.sparkContext
    if getattr(sc, "_simpairs_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="simpairs-py-"), "simpairs.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._simpairs_shipped = True
