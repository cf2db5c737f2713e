"""pass@k, its means and leaderboards over a long table of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.maths import pass_at_k
from ..functions.strings import ID_SEPARATOR

KS = (1, 3, 5, 10)


def last_runs(runs: DataFrame, order: str) -> DataFrame:
    """One row per (task_id, sample_id): the last by ``order``; combined before the shuffle."""
    best = F.max_by("passed", order).alias("passed")
    return runs.groupBy("task_id", "sample_id").agg(best)


def pass_table(runs: DataFrame, by: list[str], ks: tuple[int, ...] = KS, strict: bool = False) -> DataFrame:
    """n, c and pass@k for every group; one shuffle of partial counts."""
    counts = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))
    return counts.select(*by, "n", "c", *(pass_at_k(F.col("n"), F.col("c"), k, strict).alias(f"pass_{k}") for k in ks))


def macro_mean(table: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    return table.groupBy(*by).agg(*(F.avg(f"pass_{k}").alias(f"pass_{k}") for k in ks), F.count(F.lit(1)).alias("tasks"))


def two_level_mean(table: DataFrame, name: str, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """Mean over the seeds of the means over each seed's variants; the seed is the name before the separator."""
    fields = [*(f"pass_{k}" for k in ks), "n"]
    seed = F.element_at(F.split(F.col(name), ID_SEPARATOR), 1)
    inner = table.groupBy(*by, seed.alias("seed")).agg(*(F.avg(f).alias(f) for f in fields))
    return inner.groupBy(*by).agg(*(F.avg(f).alias(f) for f in fields))


def leaderboard(means: DataFrame, data: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """hyper and model by data x k; the datasets are given, so the pivot needs no job of its own."""
    cells = [F.max(F.when(F.col("data") == d, F.col(f"pass_{k}"))).alias(f"{d}_pass_{k}") for d in data for k in ks]
    return means.groupBy("hyper", "model").agg(*cells)


def running_mean(rows: DataFrame, value: str, weight: str, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))


def patience(rows: DataFrame, score: str, by: list[str], order: str) -> DataFrame:
    """best so far and rounds since the last strict improvement."""
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    better = F.when(F.max(score).over(past).isNull() | (F.col(score) > F.max(score).over(past)), 1).otherwise(0)
    out = rows.withColumn("best", F.max(score).over(here)).withColumn("better", better)
    out = out.withColumn("run", F.sum("better").over(here))
    since = Window.partitionBy(*by, "run").orderBy(order)
    return out.withColumn("waited", F.row_number().over(since) - 1).drop("better", "run")
