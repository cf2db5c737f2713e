"""Operator 5: token ids as static range asymmetric numeral system (rANS) files.

Tables. One frequency table serves the corpus: exact counts of every id are
summed in Spark (at most one row per vocabulary entry reaches the driver) and
scaled to a total of 2**20.

Blocks. Rows are ordered by ``doc_id`` with a range partitioning; each task
cuts its run of documents into groups of about ``block_tokens`` ids that end
where a document ends. A group is one block, or equal ones of at most ``MOST`` ids where a
document is longer, so that no block grows with a document. A block is coded by itself with ``LANES`` interleaved
coders: id i belongs to lane i mod LANES. A block holds

    magic 'GRNS', version, table checksum, ids, lanes, checkpoint interval,
    final lane states, words per lane, checkpoints (lane states and word
    positions every ``CHECK_STEPS`` steps), the words, crc32 of ids, crc32

so that any block, or any checkpoint within it, can be decoded in parallel.

The container is a Parquet folder with one row per group (its blocks one after the other, each
with its length before it), in ascending order of
(part, block): it can be written and read through any store that Spark knows.

Nulls, ties: a null text is the empty text (its only id is the end id); a null
``doc_id`` sorts first; rows with equal ``doc_id`` are ordered by their text's
hash, and repeated rows are each kept. Other columns are ignored. An empty
table gives no block and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

SCALE_BITS = 20
LANES = 64
CHECK_STEPS = 256
BLOCK_TOKENS = 32_768
#: Ids of a block at most.
MOST = 2 * BLOCK_TOKENS
#: Blocks coded side by side in one numpy pass: of much the same length, which bounds its memory.
SIDE_BY_SIDE = 32

_MAGIC, _VERSION = b"GRNS", 1
_HEAD = struct.Struct("<4sIIQIII")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK32 = np.uint64(0xFFFFFFFF)


def scaled(counts: dict[int, int], vocabulary: int) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for every id that occurs."""
    freq = np.zeros(vocabulary, dtype=np.int64)
    if not counts:
        return freq
    ids = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[i] for i in ids.tolist()], dtype=np.float64)
    whole = 1 << SCALE_BITS
    f = np.maximum(1, np.floor(n / n.sum() * whole)).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - whole
    while over:  # the most frequent ids absorb the rounding
        step = np.sign(over)
        take = order[: abs(over)]
        take = take[f[take] > 1] if step > 0 else take
        f[take] -= step
        over = int(f.sum()) - whole
    freq[ids] = f
    return freq


class Table:
    """The shared frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.both = self.freq << _WORD | self.start
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 65_536 else np.uint32), freq)
        self.check = zlib.crc32(freq.astype("<i8").tobytes())


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """Code each array of ids by itself, all side by side."""
    g, steps = len(blocks), [-(-len(b) // LANES) for b in blocks]
    most = max(steps, default=0)
    ids = np.zeros((most, g * LANES), dtype=np.uint32)
    live = np.zeros((most, g * LANES), dtype=bool)
    for k, b in enumerate(blocks):
        flat = np.zeros(steps[k] * LANES, dtype=np.uint32)
        flat[: len(b)] = b
        on = np.zeros(steps[k] * LANES, dtype=bool)
        on[: len(b)] = True
        ids[: steps[k], k * LANES : (k + 1) * LANES] = flat.reshape(-1, LANES)
        live[: steps[k], k * LANES : (k + 1) * LANES] = on.reshape(-1, LANES)
    x = np.full(g * LANES, _LOW, dtype=np.uint64)
    at = np.zeros(g * LANES, dtype=np.int64)
    words = np.zeros((g * LANES, most + 1), dtype=np.uint32)
    marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    shift, limit = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    even = min((len(b) for b in blocks), default=0) // LANES  # steps in which every lane has an id
    for t in range(most - 1, -1, -1):
        both = table.both[ids[t]]
        f, on = both >> _WORD, live[t]
        full = x >= (f << limit)
        if t >= even:
            full &= on
            f = np.maximum(f, np.uint64(1))
        who = np.flatnonzero(full)
        if len(who):
            over = x[who]
            words[who, at[who]] = over & _MASK32
            at[who] += 1
            x[who] = over >> _WORD
        q = x // f
        new = (q << shift) + (x - q * f) + (both & _MASK32)
        x = new if t < even else np.where(on, new, x)
        if t and t % CHECK_STEPS == 0:
            marks[t] = (x.copy(), at.copy())
    out = []
    for k, b in enumerate(blocks):
        own = slice(k * LANES, (k + 1) * LANES)
        n = at[own]
        body = [x[own].astype("<u8").tobytes(), n.astype("<u4").tobytes()]
        for t in range(CHECK_STEPS, steps[k], CHECK_STEPS):
            body += [marks[t][0][own].astype("<u8").tobytes(), marks[t][1][own].astype("<u4").tobytes()]
        body += [words[k * LANES + i, : n[i]].astype("<u4").tobytes() for i in range(LANES)]
        head = _HEAD.pack(_MAGIC, _VERSION, table.check, len(b), LANES, CHECK_STEPS, zlib.crc32(b.astype("<u4").tobytes()))
        block = head + b"".join(body)
        out.append(block + struct.pack("<I", zlib.crc32(block)))
    return out


def decode_blocks(blocks: list[bytes], table: Table, checkpoint: int = 0, check: bool = True) -> list[np.ndarray]:
    """The ids of each block, or those from its ``checkpoint``-th checkpoint on; raises on a wrong checksum."""
    g, heads, states, left, texts = len(blocks), [], [], [], []
    for b in blocks:
        head = _HEAD.unpack_from(b)
        if head[:2] != (_MAGIC, _VERSION) or head[4:6] != (LANES, CHECK_STEPS):
            raise ValueError("not a block of this format")
        if check and zlib.crc32(memoryview(b)[:-4]) != struct.unpack("<I", b[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        if head[2] != table.check:
            raise ValueError("the block was made with another table")
        steps = -(-head[3] // LANES)
        marks = max(0, -(-steps // CHECK_STEPS) - 1)
        p = _HEAD.size
        n = np.frombuffer(b, "<u4", LANES, p + 8 * LANES).astype(np.int64)
        q = p + 12 * LANES * checkpoint
        if checkpoint > marks:
            raise ValueError("the block has fewer checkpoints")
        states.append(np.frombuffer(b, "<u8", LANES, q))
        left.append(np.frombuffer(b, "<u4", LANES, q + 8 * LANES).astype(np.int64))
        texts.append((np.frombuffer(b, "<u4", int(n.sum()), p + 12 * LANES * (1 + marks)), np.concatenate(([0], np.cumsum(n)[:-1]))))
        heads.append((head[3], steps, head[6]))
    if not blocks:
        return []
    base = np.cumsum([0] + [len(t) for t, _ in texts[:-1]])
    words = np.concatenate([t for t, _ in texts] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    x = np.concatenate(states).astype(np.uint64)
    first = np.concatenate([o + k for (_, o), k in zip(texts, base)])
    at = np.concatenate(left)
    begin = checkpoint * CHECK_STEPS
    total = np.repeat([h[0] for h in heads], LANES)
    lane = np.tile(np.arange(LANES), g)
    most = max(h[1] for h in heads)
    out = np.zeros((max(0, most - begin), g * LANES), dtype=np.uint32)
    shift, low = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    even = min(h[0] for h in heads) // LANES  # steps in which every lane has an id
    for t in range(begin, most):
        slot = x & low
        s = table.symbol[slot.view(np.int64)]
        both = table.both[s]
        new = (both >> _WORD) * (x >> shift) + slot - (both & _MASK32)
        if t >= even:
            on = t * LANES + lane < total
            new = np.where(on, new, x)
        who = np.flatnonzero(new < _LOW)
        if len(who):
            who = who[at[who] > 0]
            at[who] -= 1
            new[who] = (new[who] << _WORD) | words[first[who] + at[who]]
        x = new
        out[t - begin] = s
    found = []
    for k, (n, _, crc) in enumerate(heads):
        ids = out[:, k * LANES : (k + 1) * LANES].reshape(-1)[: max(0, n - begin * LANES)].copy()
        if check and not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("the decoded ids' checksum is wrong")
        found.append(ids)
    return found


def frames(ids: np.ndarray) -> list[np.ndarray]:
    """A group's ids as equal blocks of at most ``MOST``."""
    return np.array_split(ids, max(1, -(-len(ids) // MOST)))


def coded_groups(groups: list[np.ndarray], table: Table) -> list[bytes]:
    """Each group's blocks with their lengths."""
    own = [(k, f) for k, ids in enumerate(groups) for f in frames(ids)]
    out: list[list[bytes]] = [[] for _ in groups]
    order = sorted(range(len(own)), key=lambda i: len(own[i][1]))
    done: list = [b""] * len(own)
    for at in range(0, len(order), SIDE_BY_SIDE):
        part = order[at : at + SIDE_BY_SIDE]
        for i, block in zip(part, encode_blocks([own[i][1] for i in part], table)):
            done[i] = block
    for (k, _), block in zip(own, done):
        out[k] += [struct.pack("<I", len(block)), block]
    return [b"".join(x) for x in out]


def decoded_groups(groups: list[bytes], table: Table) -> list[np.ndarray]:
    """Each group's ids."""
    own = []
    for k, g in enumerate(groups):
        at = 0
        while at < len(g):
            n = struct.unpack_from("<I", g, at)[0]
            own.append((k, g[at + 4 : at + 4 + n]))
            at += 4 + n
    order, done = sorted(range(len(own)), key=lambda i: len(own[i][1])), [None] * len(own)
    for at in range(0, len(order), SIDE_BY_SIDE):
        part = order[at : at + SIDE_BY_SIDE]
        for i, ids in zip(part, decode_blocks([own[i][1] for i in part], table)):
            done[i] = ids
    out: list[list[np.ndarray]] = [[] for _ in groups]
    for (k, _), ids in zip(own, done):
        out[k].append(ids)
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


_BLOCKS = "part int, block int, begin long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, ids binary"
_FILES = "part int, block int, begin long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, bytes binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(a.split()[0], kinds[a.split()[1]]) for a in schema.split(", ")])


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` range-partitioned and sorted by doc_id and their text's hash.

    The ranges come from quantiles of doc_id alone, so the texts are not read to sample
    them. Equal ids stay together; where one (or rows without an id) holds more than a part's share, or where
    there are too many parts for an expression, Spark's own range partitioning by both keys takes over.
    """
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ids = rows.select("doc_id")
    seen = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n")).first()
    cuts = seen["cuts"] or []
    if len(set(cuts)) != parts - 1 or parts > 1000 or seen["nameless"] * parts > seen["n"]:
        return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def place(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") <= cuts[mid], place(low, mid)).otherwise(place(mid + 1, high))

    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place(0, parts - 1))
    return rows.repartitionById(parts, part).sortWithinPartitions(*keys)


def token_blocks(docs: DataFrame, path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents in ascending ``doc_id`` order as blocks of ids; ``begin`` counts within the part.

    A part's last row, with block -1, has the ids that occur in it and their counts as doc_ids and doc_tokens.
    """
    parts = common.tune(docs.sparkSession)
    rows = in_order(common.whole_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts)
    schema = _arrow(_BLOCKS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        part, block, begin = TaskContext.get().partitionId(), 0, 0
        ids, names, lens, held = [], [], [], 0
        total = np.zeros(0, dtype=np.int64)

        def row(place, n, names, lens, ids):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (names, pa.array(lens, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([begin]), pa.array([n]), *lists, pa.array([ids], pa.binary())], schema=schema)

        def close():
            nonlocal block, begin, ids, names, lens, held
            out = row(block, held, pa.concat_arrays(names), np.concatenate(lens), np.concatenate(ids).tobytes())
            block, begin = block + 1, begin + held
            ids, names, lens, held = [], [], [], 0
            return out

        for batch in tokens.gathered(batches):
            got, n = enc.closed(batch["text"].chunk(0), end_id)
            docs = batch["doc_id"].chunk(0)
            seen = np.bincount(got, minlength=len(total))
            seen[: len(total)] += total
            total = seen
            # A group ends with the document that brings it to ``block_tokens``.
            first, end = 0, np.cumsum(n)
            while first < len(n):
                before = int(end[first - 1]) if first else 0
                last = min(int(np.searchsorted(end, before + block_tokens - held)), len(n) - 1)
                ids.append(got[before : end[last]])
                names.append(docs.slice(first, last + 1 - first))
                lens.append(n[first : last + 1])
                held += int(end[last]) - before
                first = last + 1
                if held >= block_tokens:
                    yield close()
        if held:
            yield close()
        some = np.flatnonzero(total)
        if len(some):
            yield row(-1, 0, pa.array(some, pa.int64()), total[some], b"")

    return rows.mapInArrow(blocks, _BLOCKS)


def counted(blocks: DataFrame) -> dict[int, int]:
    """How often each id occurs; at most one row per vocabulary entry."""
    rows = blocks.where("block = -1").select(F.explode(F.arrays_zip("doc_ids", "doc_tokens")).alias("z"))
    return {r[0]: r[1] for r in rows.groupBy("z.doc_ids").agg(F.sum("z.doc_tokens")).collect()}


def write(docs: DataFrame, folder: str, path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> Table:
    """Write the documents' ids to ``folder``; returns the table, which ``read`` needs."""
    blocks = common.written(token_blocks(docs, path, end_id, block_tokens), "ids")
    common.swept(docs.sparkSession)
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    width = np.dtype("<u2" if vocabulary <= 65_536 else "<u4")
    freq = scaled(counted(blocks), vocabulary)
    schema = _arrow(_FILES)

    def code(batches):
        shared = Table(freq)
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                part = batch.slice(at, SIDE_BY_SIDE)
                got = coded_groups([np.frombuffer(x.as_buffer(), dtype=width) for x in part["ids"]], shared)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.binary())], schema=schema)

    blocks.where("block >= 0").mapInArrow(tokens.released(code), _FILES).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(folder)
    common.dropped(blocks)
    return Table(freq)


def read(spark: SparkSession, folder: str, table: Table, digest: bool = False) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens and the ids (unsigned 32-bit, little-endian) of each document, or their crc32 as ids_crc32."""
    common.tune(spark)
    files = spark.read.parquet(folder)
    # One row per part: a prefix sum over the parts' totals places each part.
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    offset, so_far = {}, 0
    for part in sorted(totals):
        offset[part], so_far = so_far, so_far + totals[part]
    freq = table.freq.astype(np.int64)
    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    show = zlib.crc32 if digest else bytes
    schema = _arrow(f"doc_id long, start long, n_tokens long, {last} {kind}")

    def decode(batches):
        shared = Table(freq)
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                rows = batch.slice(at, SIDE_BY_SIDE).to_pylist()
                out = {"doc_id": [], "start": [], "n_tokens": [], last: []}
                for row, ids in zip(rows, decoded_groups([r["bytes"] for r in rows], shared)):
                    begin, ids = 0, ids.astype("<u4")
                    for doc, n in zip(row["doc_ids"], row["doc_tokens"]):
                        out["doc_id"].append(doc)
                        out["start"].append(offset[row["part"]] + row["begin"] + begin)
                        out["n_tokens"].append(n)
                        out[last].append(show(ids[begin : begin + n]))
                        begin += n
                yield pa.RecordBatch.from_pydict(out, schema)

    return files.select("part", "begin", "n_tokens", "doc_ids", "doc_tokens", "bytes").mapInArrow(tokens.released(decode), f"doc_id long, start long, n_tokens long, {last} {kind}")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` with the byte-level vocabulary and digest what the files give back."""
    import uuid

    import public_tokenizers

    folder = f"{common.shared_dir(spark)}/gradus-rans-{uuid.uuid4().hex}"
    table = write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read(spark, folder, table, digest=True)
