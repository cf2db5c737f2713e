"""Seeded sampling and exact splits.

A random order is the md5 of the seed and the key: it is the same in any
engine, partitioning and rerun.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def one_per_group(rows: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """A random row of each group: an aggregate with partial results, no window."""
    columns = F.struct(*rows.columns)
    return rows.groupBy(*group).agg(F.min_by(columns, draw(seed, key)).alias("r")).select("r.*")


def smallest(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """The n rows first in ``order``: top-n per task, then of those."""
    return rows.withColumn("__order", order).orderBy("__order").limit(n).drop("__order")


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return smallest(rows, n, draw(seed, key))


def thresholds(rows: DataFrame, key: str, seed: int, shares: list[float], bins: int = 4096) -> list[tuple[int, int, int]]:
    """For cumulated sizes int(n * share): (bin, rows before that bin, rows wanted), from a histogram of the order's first digits."""
    first = F.conv(F.substring(draw(seed, key), 1, 3), 16, 10).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(first.alias("b")).count().collect()}
    n = sum(counts.values())
    out, want = [], 0
    for share in shares:
        want += int(n * share)
        so_far = 0
        for b in range(bins):
            if so_far + counts.get(b, 0) > want:
                break
            so_far += counts.get(b, 0)
        else:
            b = bins
        out.append((b, so_far, want))
    return out


def split(rows: DataFrame, key: str, seed: int, parts: dict[str, float]) -> DataFrame:
    """``rows`` with ``split``: consecutive runs of int(n * share) rows of the random order; the rest is dropped.

    A histogram of the order's first three digits settles all rows but those of
    the bins that a boundary cuts; only they are ranked.
    """
    if sum(parts.values()) > 1 + 1e-12:
        raise ValueError("shares exceed one")
    cuts = thresholds(rows, key, seed, list(parts.values()))
    own = rows.withColumn("__draw", draw(seed, key)).withColumn("__bin", F.conv(F.substring("__draw", 1, 3), 16, 10).cast("int"))
    cut_bins = sorted({b for b, _, _ in cuts})
    ranked = F.row_number().over(Window.partitionBy("__bin").orderBy("__draw", key)) - 1
    inside = own.where(F.col("__bin").isin(cut_bins)).withColumn("__rank", ranked)
    outside = own.where(~F.col("__bin").isin(cut_bins)).withColumn("__rank", F.lit(0))
    label = F.lit(None).cast("string")
    for name, (b, before, want) in reversed(list(zip(parts, cuts))):
        label = F.when((F.col("__bin") < b) | ((F.col("__bin") == b) & (F.col("__rank") + before < want)), name).otherwise(label)
    return inside.unionByName(outside).withColumn("split", label).where("split IS NOT NULL").drop("__draw", "__bin", "__rank")


def few_shot(rows: DataFrame, label: str, order: str, shots: int, last: bool = False) -> DataFrame:
    """The first (or last) ``shots`` rows of each of the labels 0 to 4 in input order."""
    w = Window.partitionBy(label).orderBy(F.desc(order) if last else F.asc(order))
    return rows.where(F.col(label).between(0, 4)).withColumn("shot", F.row_number().over(w)).where(F.col("shot") <= shots)
