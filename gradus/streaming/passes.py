"""pass@k kept up to date over a stream of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import KS, pass_table


def pass_stream(runs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """n, c and pass@k of every task seen: state is two counters a task."""
    return pass_table(runs, ["task_id"], ks)


def start(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what has arrived and stop; the checkpoint makes a restart go on from there.

    Every batch writes the tasks that changed to a folder of its own below ``path``, so nothing is
    gathered on the driver and a batch that is run again replaces itself.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return pass_stream(runs).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each task: a max by batch, combined before its shuffle."""
    rows = spark.read.parquet(path)
    return rows.groupBy("task_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("task_id", "batch"))), "batch").alias("r")).select("task_id", "r.*")
