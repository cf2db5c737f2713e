"""Operator 12: embedding whitening by matrix-free block subspace iteration.

The covariance V of the fit list is never built. A block of ``BLOCK`` orthonormal
columns Q is kept on the driver; a Spark pass gives VQ as the sum of Xᵀ(XQ) over centred
rows, the tasks' sums being added by Spark. Rayleigh-Ritz on the product gives the best
eigenpairs within the block and their residuals ‖Vu - eu‖; the iteration ends once
those of all k components are under ``TOLERANCE`` times the largest eigenvalue (or, from
``ENOUGH`` on, no longer fall, which is rounding). Between two such looks the block is multiplied
by V up to ``DEGREE`` times, combined as a Chebyshev polynomial that is small
on what lies below the block's least Ritz value, and made orthonormal by QR. Memory and
traffic are length x ``BLOCK`` numbers a task, whatever the number of rows.

The fit list is each distinct vector of integers once (partial aggregation takes copies out before
the shuffle), written once; each pass reads it. Means are exact sums of integers, and
deviations are exact: ``deviation`` is null where its value leaves 64 bits, and
``deviation_text`` has its digits at any size.

Nulls, ties: vectors that are null, empty or hold null or non-finite components give no
rows; components whose floor leaves 64 bits count as the nearest 64-bit integer. Rows with null or repeated vec_id each
give their rows. Vectors of another length are whitened by a fit of their own. Equal
eigenvalues may come in any basis of their space. A component without variance (fewer
distinct vectors than components, constant dimensions) has null whitened values, explained 0 and no
part in identity_error. Vectors shorter than k have as many components as their length.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens, vectors

#: Columns that are multiplied at once; twice the components if that is more.
BLOCK = 32
#: Multiplications between two looks, at most; and how far apart they may drive the columns.
DEGREE, GROWTH = 8, 1e8
#: Residuals, as a share of the largest eigenvalue: aimed at, and accepted once they stop falling.
TOLERANCE, ENOUGH = 5e-14, 1e-10
#: Looks at the residuals before giving up.
LOOKS = 200
#: A component has no variance below this share of the largest eigenvalue.
NOTHING = 1e-13

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
_INTS = 2.0**62


def _exact(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exactly."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < _INTS:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def _summed(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def add(batches):
        n, total = 0, [0] * size
        for batch in batches:
            x = vectors.matrix(batch["x"])
            n += len(x)
            if len(x):
                most = max(abs(int(x.max())), abs(int(x.min()))) * len(x)
                own = x.sum(axis=0) if most < _INTS else x.astype(object).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, own)]
        yield pa.RecordBatch.from_pydict({"place": pa.array([*range(size), size], pa.int32()), "total": [*map(str, total), str(n)]})

    parts = fit.mapInArrow(tokens.released(add), "place int, total string")
    got = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["place"]: int(r["total"]) for r in got}
    return found.get(size, 0), [found.get(i, 0) for i in range(size)]


def multiplied(fit: DataFrame, mean: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Vq: one pass over the rows of ``fit``."""
    shape = q.shape

    def product(batches):
        total = np.zeros(shape)
        for batch in batches:
            x = vectors.matrix(batch["x"]).astype(np.float64) - mean
            total += x.T @ (x @ q)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["place", "value"])

    got = fit.mapInArrow(tokens.released(product), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(q.size)
    out[got["place"].to_numpy()] = got["value"].to_numpy()
    return out.reshape(shape) / n


def orthonormal(y: np.ndarray) -> np.ndarray:
    """QR of columns brought to one length; columns of zeros become directions outside the others' span."""
    size = np.linalg.norm(y, axis=0)
    return np.linalg.qr(np.where(size > 0, y / np.where(size > 0, size, 1), 0))[0]


def degree(first: float, last: float) -> int:
    """Most multiplications that keep the polynomial's value at the largest eigenvalue under ``GROWTH``."""
    t = 2 * first / last - 1 if last > 0 else np.inf
    return int(max(1, min(DEGREE, np.arccosh(GROWTH) / np.arccosh(t)))) if 1 < t < 1e15 else 1


def eigenpairs(times, size: int, k: int, block: int | None = None, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues and their unit vectors (columns) of a symmetric matrix of which ``times`` gives products, and the passes that took."""
    width = min(size, block or max(BLOCK, 2 * k))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    passes, before = 0, np.inf
    for _ in range(LOOKS):
        y = times(q)
        passes += 1
        inner = q.T @ y
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        residual = np.linalg.norm(y - q * values, axis=0)[:k].max()
        whole = max(values[0], np.finfo(float).tiny)
        if residual <= TOLERANCE * whole or (residual <= ENOUGH * whole and residual > before / 2):
            return values[:k], q[:, :k], passes
        before = residual
        last = max(values[-1], 0.0)
        half = last / 2
        older, newer = q, (y - half * q) / half if half > 0 else y
        for _ in range(degree(whole, last) - 1):
            older, newer = newer, 2 * (times(newer) - half * newer) / half - older
            passes += 1
        q = orthonormal(newer)
    raise RuntimeError(f"residuals of {k} components are not under {ENOUGH} after {passes} passes")


def _identity_error(fit: DataFrame, mean: np.ndarray, turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; the tasks' moments are merged about their means."""
    k = turn.shape[1]

    def moments(batches):
        n, m, s = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = (vectors.matrix(batch["x"]).astype(np.float64) - mean) @ turn
            if len(w):
                n, m, s = merged((n, m, s), (len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0))))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m.tolist()]), pa.array([s.reshape(-1).tolist()])], names=["n", "m", "s"])

    # A few dozen numbers a task.
    rows = fit.mapInArrow(tokens.released(moments), "n long, m array<double>, s array<double>").collect()
    n, _, s = reduce(merged, ((r["n"], np.array(r["m"]), np.array(r["s"]).reshape(k, k)) for r in rows), (0, np.zeros(k), np.zeros((k, k))))
    return float(np.abs(s / n - np.eye(k)).max())


def merged(one: tuple, other: tuple) -> tuple:
    """Count, mean and scatter of two sets of rows together."""
    n = one[0] + other[0]
    if not one[0] or not other[0]:
        return one if one[0] else other
    d = other[1] - one[1]
    return n, one[1] + d * other[0] / n, one[2] + other[2] + np.outer(d, d) * one[0] * other[0] / n


@common.tidy
def whitened(df: DataFrame, k: int = 4) -> DataFrame:
    """``OUT`` for every row of vec_id and x (integers), k components each, most variance first."""
    spark = df.sparkSession
    common.tune(spark)
    found = []
    for rows in vectors.by_length(df.withColumnRenamed("x", "v")):
        rows = rows.select("vec_id", F.col("v").alias("x"))
        size = rows.select(F.size("x")).first()[0]
        fit = common.written(rows.select("x").distinct(), "fit")
        n, sums = _summed(fit, size)
        mean = np.array([s / n for s in sums])
        many = min(k, size)
        values, axes, _ = eigenpairs(lambda q: multiplied(fit, mean, q, n), size, many)
        trace = _trace(fit, mean, n)
        real = values > NOTHING * max(values[0], 0.0)
        scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0.0)
        turn = axes * scale
        error = _identity_error(fit, mean, turn[:, real]) if real.any() else 0.0
        found.append(rows.mapInArrow(tokens.released(_projector(n, sums, mean, turn, real, np.where(real, values, 0.0) / trace if trace > 0 else np.zeros(many), error)), OUT))
        common.dropped(fit)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], OUT)


def _trace(fit: DataFrame, mean: np.ndarray, n: int) -> float:
    def squares(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(float(((vectors.matrix(b["x"]) - mean) ** 2).sum()) for b in batches)])], names=["value"])

    return fit.mapInArrow(tokens.released(squares), "value double").agg(F.sum("value")).first()[0] / n


def _projector(n: int, sums: list[int], mean: np.ndarray, turn: np.ndarray, real: np.ndarray, explained: np.ndarray, error: float):
    k = turn.shape[1]

    def project(batches):
        for batch in batches:
            x = vectors.matrix(batch["x"])
            w = (x.astype(np.float64) - mean) @ turn
            far = _exact(x, n, sums)
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array([d if d < 2**63 else None for d in far for _ in range(k)], pa.int64()),
                    pa.array(w.reshape(-1), mask=np.tile(~real, rows)),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                    pa.array([str(d) for d in far for _ in range(k)], pa.string()),
                ],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    return project


def integers(df: DataFrame) -> DataFrame:
    """vec_id and x, floor(256 * component), of the rows whose ``embedding`` is whole and finite."""
    v = F.col("embedding").cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-(2.0**63)), F.least(F.lit(2.0**63 - 1024), c * 256.0))).cast("long"))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four components of every row of ``embeddings``."""
    return whitened(integers(common.table(spark, sf_dir, "embeddings")), 4)
