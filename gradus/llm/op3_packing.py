"""Operator 3: packing by concatenation and cutting.

Pass 1 encodes every document where it lies and writes, per document, its ids
and their place within the task's run. The runs' totals (one row per partition)
are summed to prefixes, which give each run its global offset. Pass 2 cuts the
documents at the multiples of the window: no row moves between machines. A
sequence that two runs share is made of boundary records on either side; pieces
carry their sequence and offset, so nothing needs to be brought together.

Every sequence is full but the last, so at most ``window`` - 1 ids are padding
over the whole corpus.

Nulls, ties: a null text is the empty text, whose only id is the end id; null
or repeated ``doc_id`` values are kept, one document per row. Other columns are
ignored. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

WINDOW = 4096
#: Words a worker remembers where other stages follow in the same workers.
CACHE_WORDS = 40_000

_RUNS = "part int, begin long, doc_id long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, boundary boolean"


def runs(docs: DataFrame, path: str, end_id: int, keep: bool = True) -> DataFrame:
    """Ids of each document, placed within its partition's run. Without ``keep`` a task holds few texts at once and leaves no encoder behind in its worker."""
    common.tune(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("begin", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            tokens.trimmed()  # what earlier stages' tasks left in this worker
        enc = tokens.encoder(path) if keep else tokens.encoder(path, CACHE_WORDS)
        part, begin = TaskContext.get().partitionId(), 0
        for batch in tokens.gathered(batches, most=tokens.BYTES if keep else tokens.FEW_BYTES):
            ids, n = enc.closed(batch["text"].chunk(0), end_id)
            first = begin + np.concatenate(([0], np.cumsum(n)))
            begin = int(first[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(first[:-1]), batch["doc_id"].chunk(0), pa.array(n), tokens.slices(ids, n)], schema=schema)
        if not keep:
            tokens.release()

    rows = common.whole_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, _RUNS)


@common.tidy
def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, digest: bool = False, keep: bool = True) -> DataFrame:
    """Pieces of all documents with their ids (unsigned 32-bit, little-endian) or their crc32 as ids_crc32, sequence and offset."""
    placed = common.written(runs(docs, path, end_id, keep), "runs")
    totals = {r["part"]: (r["n"], r["w"]) for r in placed.groupBy("part").agg(F.sum("n_tokens").alias("n"), (F.max(F.length("ids") / F.col("n_tokens"))).alias("w")).collect()}
    offset, so_far = {}, 0
    for part in sorted(totals):
        offset[part], so_far = so_far, so_far + totals[part][0]
    ends = {p: offset[p] + totals[p][0] for p in totals}
    width = np.dtype("<u4" if any(w > 3 for _, w in totals.values()) else "<u2")
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    show = zlib.crc32 if digest else bytes
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), last, ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("boundary", pa.bool_())]

    def cut(batches):
        for batch in batches:
            out = {k: [] for k, _ in kinds}
            for part, begin, doc, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.frombuffer(ids, dtype=width).astype("<u4")
                at, low, high, done = offset[part] + begin, offset[part], ends[part], 0
                while done < n:
                    sequence, place = divmod(at + done, window)
                    take = min(n - done, window - place)
                    shared = sequence * window < low or (sequence + 1) * window > high
                    for k, v in zip(out, (doc, done, take, show(wide[done : done + take]), n, sequence, place, shared)):
                        out[k].append(v)
                    done += take
            yield pa.RecordBatch.from_pydict(out, pa.schema(kinds))

    return placed.mapInArrow(tokens.released(cut), _PIECES.replace("ids binary", "ids_crc32 long") if digest else _PIECES)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack ``documents`` with the word vocabulary into sequences of 4096."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, digest=True)
