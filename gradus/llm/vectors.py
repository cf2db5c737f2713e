"""What the two vector searches share: valid vectors, bounded pivots, blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common, tokens

#: Rows that pivots are chosen from, in the order of a hash of vec_id.
PIVOT_SAMPLE = 4096
#: Queries that meet a block of rows at once.
QUERY_BLOCK = 16_384
#: Rows that are searched at once; their block is a hash of vec_id, whatever the partitions.
INDEX_BLOCK = 4096
#: Rows that one task meets with one block of queries.
TASK_ROWS = 262_144


def valid(df: DataFrame) -> DataFrame:
    """vec_id and v (doubles), without vectors that are null, empty or hold null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))


def by_length(df: DataFrame) -> list[DataFrame]:
    """The rows of each length of vectors that occurs: inner products are of equal lengths only."""
    found = df.select(F.size("v").alias("n")).distinct().orderBy("n").collect()
    return [df.where(F.size("v") == r["n"]) if len(found) > 1 else df for r in found]


def sample(df: DataFrame, rows: int = PIVOT_SAMPLE) -> np.ndarray:
    """The vectors of a bounded sample of rows of one length."""
    got = [r["v"] for r in df.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(rows).collect()]
    return np.array(got, dtype=np.float64) if got else np.zeros((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def chunks(batches, rows: int = INDEX_BLOCK):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def crossed(index: DataFrame, every: int, parts: int, search: Callable, schema: str) -> DataFrame:
    """What ``search`` finds for the rows whose vec_id is divisible by ``every`` among all rows of ``index`` (vec_id, row, v, x).

    Rows are dealt to blocks and queries to turns; a cell is some blocks and one turn,
    and one task works on it. Queries, like rows, only move between executors.
    ``search(queries)`` makes an object that is given block after block (``meet``) and then asked
    for a record batch (``found``).
    """
    asked = index.where(F.col("vec_id") % every == 0)
    rows, queries = index.count(), asked.count()
    blocks, turns = max(1, -(-rows // INDEX_BLOCK)), max(1, -(-queries // QUERY_BLOCK))
    tasks = min(blocks, max(parts, -(-rows // TASK_ROWS)))
    names = ["vec_id", "row", "v", "x"]

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    members = index.select(*names, block.alias("block")).select(*names, "block", F.lit(1).alias("kind"), (F.col("block") % tasks).alias("task"), all_of(turns).alias("turn"))
    turn = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(turns)).cast("int")
    queries = asked.select(*names, F.lit(0).alias("block"), F.lit(0).alias("kind"), all_of(tasks).alias("task"), turn.alias("turn"))
    cells = members.unionByName(queries).withColumn("cell", F.col("task") * turns + F.col("turn"))
    cells = cells.select("cell", "kind", "block", *names).repartitionById(max(1, min(tasks * turns, 8 * parts)), F.col("cell")).sortWithinPartitions("cell", "kind", "block")

    def solve(batches):
        key, state, held = None, None, []

        def whole():
            out = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return out.select(names)

        def close():
            nonlocal state
            if not held:
                return
            if key[1] == 0:
                state = search(whole())
            elif state is not None:
                state.meet(whole())
            held.clear()

        for batch in batches:
            marks = np.stack([batch[c].to_numpy() for c in ("cell", "kind", "block")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                now = tuple(marks[:, low].tolist())
                if now != key:
                    close()
                    if key is not None and now[0] != key[0]:
                        if state is not None:
                            yield state.found()
                        state = None
                    key = now
                held.append(batch.slice(low, high - low))
        close()
        if state is not None:
            yield state.found()

    return cells.mapInArrow(tokens.released(solve), schema)


def indexed(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once, with a number for each row."""
    return common.written(df.withColumn("row", F.monotonically_increasing_id()), tag)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's best k of what the tasks found; ties to the smaller vec_id."""
    w = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
