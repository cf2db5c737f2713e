"""Operator 6: approximate nearest neighbours with a permutation index.

Pivots are ``PIVOTS`` rows of a bounded sample. Every vector is represented by
its ``PREFIX`` nearest pivots in order, and every block of rows has an inverted file: for each
pivot the rows that it is near to and its position in their orders. A query has its own order, of
``ASKED`` pivots, and reads only their files. Two orders' footrule distance, with
pivots beyond a prefix at position L = ASKED, is a constant less twice the sum over shared
pivots of the smaller of L - position, so a query adds up the postings it reads: on the average
PREFIX * ASKED / PIVOTS for each row of a block.
The ``SHARE`` of a block's rows with the smallest footrule distance is reranked by the true
inner product in double precision.

Rows are dealt to blocks of about ``vectors.INDEX_BLOCK`` by a hash of vec_id, whatever the partitions, and
queries, in blocks too, meet them (``vectors.crossed``); a window over
each block's k best merges them.

Nulls, ties: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without vec_id; vectors are searched among those of their own
length. Equal scores go to the smaller vec_id, equal footrule distances to the earlier row. A repeated
vec_id is a row of its own. Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens, vectors

PIVOTS, PREFIX, ASKED = 1024, 32, 128
SHARE = 0.2
#: Rows reranked at least: the answers asked for must be among them in small blocks too.
LEAST = 64
#: Cosine from which two pivots are alike.
ALIKE = 0.9

_FOUND = "query_id long, query_row long, vec_id long, score double"
_KINDS = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots in order."""
    prefix = min(prefix, len(pivots))
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    some.sort(axis=1)  # ties to the earlier pivot
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1).astype(np.int16)


def diverse(sample: np.ndarray, count: int, alike: float = ALIKE) -> np.ndarray:
    """Unit pivots of the sample in its order: all but a sixteenth unlike all before them, so that a tight group is one direction to the rest; the others as they come, to tell its members apart."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, spare = [], []
    for i in range(len(unit)):
        if len(chosen) == count - count // 16:
            break
        (chosen if not chosen or (unit[chosen] @ unit[i]).max() < alike else spare).append(i)
    rest = [i for i in range(len(unit)) if i not in set(chosen)]
    return unit[chosen + rest[: count - len(chosen)]]


class InvertedFile:
    """A block's postings by pivot: rows and their weights (``top`` less the pivot's position)."""

    def __init__(self, near: np.ndarray, pivots: int, top: int):
        order = np.argsort(near.reshape(-1), kind="stable")
        self.rows = (order // near.shape[1]).astype(np.int32)
        self.weights = (top - order % near.shape[1]).astype(np.int32)
        self.start = np.searchsorted(near.reshape(-1)[order], np.arange(pivots + 1))

    def shared(self, asked: np.ndarray, top: int, size: int) -> np.ndarray:
        """For each row the sum over the pivots that it shares with the query of the smaller weight."""
        rows, found = [], []
        for place, p in enumerate(asked.tolist()):
            low, high = self.start[p], self.start[p + 1]
            rows.append(self.rows[low:high])
            found.append(np.minimum(self.weights[low:high], top - place))
        return np.bincount(np.concatenate(rows), weights=np.concatenate(found), minlength=size)


class Search:
    """Queries' k best among the rows nearest by footrule in each block that they meet."""

    def __init__(self, queries: pa.Table, pivots: np.ndarray, asked: int, share: float, least: int, k: int):
        self.ids, self.rows = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
        self.q, self.pivots, self.share, self.least, self.k = vectors.matrix(queries["v"].chunk(0)), len(pivots), share, least, k
        self.orders = orders(self.q, pivots, asked)
        self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(self.q)
        self.posted = self.reranked = self.met = 0

    def meet(self, block: pa.Table) -> None:
        ids, x = block["vec_id"].to_numpy(), vectors.matrix(block["v"].chunk(0))
        near = np.frombuffer(b"".join(block["x"].to_pylist()), dtype=np.int16).reshape(len(ids), -1)
        top = max(self.orders.shape[1], near.shape[1])
        files = InvertedFile(near, self.pivots, top)
        take = min(len(x), max(int(self.share * len(x)), self.least))
        for i in range(len(self.q)):
            shared = files.shared(self.orders[i], top, len(x))
            rows = np.argpartition(-shared, take - 1)[:take] if take < len(x) else np.arange(len(x))
            rows = rows[ids[rows] != self.ids[i]]
            named, s = np.concatenate((self.best[i][0], ids[rows])), np.concatenate((self.best[i][1], x[rows] @ self.q[i]))
            keep = np.lexsort((named, -s))[: self.k]
            self.best[i] = named[keep], s[keep]
            self.met, self.reranked = self.met + len(x), self.reranked + take

    def found(self) -> pa.RecordBatch:
        n = [len(s) for _, s in self.best]
        both = [np.concatenate([b[c] for b in self.best]) if self.best else np.zeros(0) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.repeat(self.rows, n)), pa.array(both[0].astype(np.int64)), pa.array(both[1])], schema=_KINDS)


@common.tidy
def neighbours(df: DataFrame, every: int, k: int, pivots: int = PIVOTS, prefix: int = PREFIX, asked: int = ASKED, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest found, over ``vec_id``, ``v``."""
    spark = df.sparkSession
    parts = common.tune(spark)
    found = []
    for rows in vectors.by_length(df.where(F.exists("v", lambda x: x != 0))):
        chosen = diverse(vectors.sample(rows), pivots)

        def post(batches, chosen=chosen):
            for t in vectors.chunks(batches):
                near = orders(vectors.matrix(t["v"].chunk(0)), chosen, prefix)
                yield pa.RecordBatch.from_arrays([t["vec_id"].chunk(0), t["v"].chunk(0), pa.array([r.tobytes() for r in near], pa.binary())], names=["vec_id", "v", "x"])

        index = vectors.indexed(rows.mapInArrow(tokens.released(post), "vec_id long, v array<double>, x binary"), "permutations")
        search = partial(Search, pivots=chosen, asked=asked, share=share, least=max(least, k + 1), k=k)
        found.append(common.written(vectors.crossed(index, every, parts, search, _FOUND), "near"))
        common.dropped(index)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return vectors.ranked(reduce(DataFrame.unionByName, found), k)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vec_id divisible by 20, by inner product."""
    return neighbours(vectors.valid(common.table(spark, sf_dir, "embeddings")), 20, 20)
