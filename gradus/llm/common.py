"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import functools
import gc
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import session

#: Rows per Arrow batch sent to a Python worker: bounds the worker's memory.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


shared_dir = session.shared_dir


class _Open(threading.local):
    """Folders written by this thread's functions that ``tidy`` wraps and that have not returned yet."""

    def __init__(self):
        self.folders: list[list[str]] = []


_OPEN = _Open()


def tune(spark: SparkSession) -> int:
    """Ship the package, bound Arrow batches; return the session's number of shuffle partitions."""
    session.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Spark's setting that deletes the shuffle files of an action when it ends.
_ENDS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ENDING = threading.Lock()
_INSIDE: dict[int, tuple[int, str | None]] = {}


@contextlib.contextmanager
def emptied(spark: SparkSession):
    """Shuffle files of actions on frames made inside go when the action ends, not when the driver happens to collect its garbage."""
    own = spark._jsparkSession.hashCode()
    with _ENDING:
        n, before = _INSIDE.get(own, (0, None))
        if not n:
            before = spark.conf.get(_ENDS, None)
            spark.conf.set(_ENDS, "true")
        _INSIDE[own] = n + 1, before
    try:
        yield
    finally:
        with _ENDING:
            n, before = _INSIDE.pop(own)
            if n > 1:
                _INSIDE[own] = n - 1, before
            elif before is None:
                spark.conf.unset(_ENDS)
            else:
                spark.conf.set(_ENDS, before)


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The copy survives the loss of executors; it stays until the ``tidy`` function that wrote it
    returns, or longer if that one's result reads it. What was shuffled for it goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gradus-{tag}-{uuid.uuid4().hex}"
    with emptied(spark):
        df.write.option("compression", compression).option("parquet.block.size", 16 << 20).parquet(path)
    if _OPEN.folders:
        _OPEN.folders[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the folder of a frame made by ``written`` once nothing reads it any more."""
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 1)[0]
        if "/gradus-" in folder:
            _deleted(df.sparkSession, folder)


def tidy(function):
    """A function whose written tables are deleted when it returns, but those that its result reads: they go with the function that called it."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        _OPEN.folders.append([])
        try:
            out = function(*args, **kwargs)
        finally:
            own = _OPEN.folders.pop()
        read = {name.rsplit("/", 2)[-2] for name in out.inputFiles()} if isinstance(out, DataFrame) else set()
        kept = [path for path in own if path.rsplit("/", 1)[1] in read]
        if _OPEN.folders:
            _OPEN.folders[-1] += kept
        spark = SparkSession.getActiveSession()
        for path in own:
            if spark and path not in kept:
                _deleted(spark, path)
        return out

    return run


def swept(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that are no longer held."""
    gc.collect()
    spark._jvm.System.gc()


def whole_text(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with nulls in ``column`` as the empty text."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
