"""Operator 2: exact top-k by pivot-table elimination.

A table holds every vector's distances to many pivots (``SHARE`` of the vectors' length). For a query and a
vector, the distances that their pivots allow are bounded from below; the greatest such
bound in Euclidean space follows from the place of either in the pivots' span, which
its distances give, and from what is left of its norm: no other configuration with these
distances is nearer. Hence an upper bound of their inner product,
in-span product + product of the two rests. Candidates are evaluated in the order of their bounds until the
next bound is below the k-th best score: nothing that could enter the result is
left out. Bounds are widened by more than their rounding error and scores are
exact integers.

The k-th best score over the sample that pivots come from is where the search starts, so
most rows are never looked at; queries, in blocks, meet blocks of rows
(``vectors.crossed``), and a window over each block's k best merges them.

Nulls, ties: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows without vec_id; vectors are searched among those of their own
length. Equal scores go to the smaller vec_id. A repeated vec_id is a row of
its own, both as query and as candidate; a query's own rows are those of its
vec_id. A component whose floor leaves 64 bits counts as the nearest 64-bit integer, and so does a
score. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens, vectors

#: Pivots for each component of the vectors.
SHARE = 0.875
#: Candidates evaluated between two looks at the stopping rule.
STEP = 64
#: Queries whose bounds are held at once.
BOUNDS = 128

_FOUND = "query_id long, query_row long, vec_id long, score long"
_KINDS = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def spread(sample: np.ndarray, count: int, least: float = 1e-3) -> np.ndarray:
    """Pivots far from one another: each is the row farthest from the span of those before it, as long as one is."""
    chosen: list[int] = []
    rest = sample.copy()
    far = (rest**2).sum(axis=1)
    whole = far.max(initial=0.0)
    while len(chosen) < min(count, len(sample)):
        k = int(far.argmax())
        if far[k] <= least * whole:
            break
        chosen.append(k)
        unit = rest[k] / np.linalg.norm(rest[k])
        rest -= np.outer(rest @ unit, unit)
        far = (rest**2).sum(axis=1)
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


class Pivots:
    """The pivots' span: where vectors lie in it, by their distances to the pivots and their norms."""

    def __init__(self, pivots: np.ndarray):
        self.squares = (pivots**2).sum(axis=1)
        self.turn = np.linalg.inv(np.linalg.cholesky(pivots @ pivots.T)) if len(pivots) else np.zeros((0, 0))

    def placed(self, norms: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the span, and the length of what is outside, of vectors with these squared norms and distances."""
        y = (norms[:, None] + self.squares - d * d) / 2 @ self.turn.T
        return y, np.sqrt(np.maximum(norms - (y * y).sum(axis=1), 0.0))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the range in which doubles are exact, with Python's integers, and beyond 64 bits the nearest of those."""
    if len(x) and np.abs(x).max() * np.abs(q).max(initial=0) * x.shape[1] >= 2.0**52:
        return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(row, q)))) for row in x.tolist()], dtype=np.int64)
    return (x @ q).astype(np.int64)


class Search:
    """Queries' k best rows over the blocks that they meet."""

    def __init__(self, queries: pa.Table, pivots: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int):
        self.ids, self.rows = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
        self.q, self.k, self.span = vectors.matrix(queries["v"].chunk(0)), k, Pivots(pivots)
        self.norms = (self.q**2).sum(axis=1)
        self.y, self.rest = self.span.placed(self.norms, vectors.matrix(queries["x"].chunk(0)) if len(pivots) else np.zeros((len(self.q), 0)))
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.q)
        self.evaluated = 0
        # The k-th best score over some rows bounds that over all of them.
        self.least = np.full(len(self.q), -np.inf)
        for i in range(len(self.q)):
            s = scores(seeds, self.q[i])[seed_ids != self.ids[i]]
            if len(s) >= k:
                self.least[i] = np.partition(s, len(s) - k)[len(s) - k]

    def meet(self, block: pa.Table) -> None:
        ids, x = block["vec_id"].to_numpy(), vectors.matrix(block["v"].chunk(0))
        norms = (x * x).sum(axis=1)
        y, rest = self.span.placed(norms, vectors.matrix(block["x"].chunk(0)) if len(self.span.squares) else np.zeros((len(x), 0)))
        for first in range(0, len(self.q), BOUNDS):
            own = slice(first, first + BOUNDS)
            upper = self.y[own] @ y.T + self.rest[own, None] * rest[None, :]
            upper += 1e-6 * (self.norms[own, None] + norms[None, :] + 1)
            np.maximum(upper, -(2.0**63), out=upper)  # no score is less
            for i, bound in enumerate(upper, first):
                best_ids, best = self.best[i]
                least = max(self.least[i], best[-1]) if len(best) == self.k else self.least[i]
                open_ = np.flatnonzero((bound >= least) & (ids != self.ids[i]))
                open_ = open_[np.argsort(-bound[open_], kind="stable")]
                for at in range(0, len(open_), STEP):
                    if len(best) == self.k and bound[open_[at]] < best[-1]:
                        break
                    part = open_[at : at + STEP]
                    self.evaluated += len(part)
                    named, s = np.concatenate((best_ids, ids[part])), np.concatenate((best, scores(x[part], self.q[i])))
                    keep = np.lexsort((named, ~s))[: self.k]  # ~ turns the order of all integers round
                    best_ids, best = named[keep], s[keep]
                self.best[i] = best_ids, best

    def found(self) -> pa.RecordBatch:
        n = [len(s) for _, s in self.best]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.repeat(self.rows, n)), *(pa.array(np.concatenate([b[c] for b in self.best]) if self.best else np.zeros(0, np.int64)) for c in (0, 1))], schema=_KINDS)


def pivot_table(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, the integer vector v and its pivot distances x."""

    def measure(batches):
        for t in vectors.chunks(batches):
            d = distances(vectors.matrix(t["v"].chunk(0)), pivots)
            cut = pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([t["vec_id"].chunk(0), t["v"].chunk(0), pa.ListArray.from_arrays(cut, pa.array(d.reshape(-1)))], names=["vec_id", "v", "x"])

    return df.mapInArrow(tokens.released(measure), "vec_id long, v array<double>, x array<double>")


@common.tidy
def top_k(df: DataFrame, every: int, k: int, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` largest integer inner products with other rows of ``vec_id``, ``v``."""
    spark = df.sparkSession
    parts = common.tune(spark)
    found = []
    for rows in vectors.by_length(df):
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(vectors.PIVOT_SAMPLE).collect()
        ids, sample = np.array([r["vec_id"] for r in picked], np.int64), np.array([r["v"] for r in picked], np.float64)
        pivots = spread(sample, max(1, int(share * sample.shape[1])))
        index = vectors.indexed(pivot_table(rows, pivots), "pivots")
        found.append(common.written(vectors.crossed(index, every, parts, partial(Search, pivots=pivots, seeds=sample, seed_ids=ids, k=k), _FOUND), "topk"))
        common.dropped(index)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return vectors.ranked(reduce(DataFrame.unionByName, found), k)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every vec_id divisible by 50, on floor(256 * x)."""
    v = F.transform("v", lambda x: F.floor(x * 256.0).cast("double"))
    whole = vectors.valid(common.table(spark, sf_dir, "embeddings")).withColumn("v", v)
    return top_k(whole, 50, 5)
