"""Session set-up."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Tasks a core that rows are dealt over.
TASKS = 4
_SHIPPED: dict[str, str] = {}
#: Threads that start together set a session up once.
_SETUP = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    with _SETUP:
        return _shared_dir(spark)


def _shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = sc.getCheckpointDir()
        if known:
            return known
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gradus-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker of the session."""
    with _SETUP:
        _ship(spark.sparkContext)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over all cores, before Python works on each: a small file is one task, however many rows it holds.

    Best on narrow rows, before texts are made of them.
    """
    return rows.repartition(TASKS * max(2, rows.sparkSession.sparkContext.defaultParallelism))


def _ship(sc) -> None:
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gradus-"), "gradus.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if not name.endswith(".pyc"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED[sc.applicationId] = path
