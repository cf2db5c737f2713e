"""Operator 7: n-gram Jaccard join by a blocked sparse matrix product.

Documents are sets of hashed shingles of ``words`` words; two link when
100 * intersection >= ``percent`` * union. The result is each document's set size
and the smallest doc_id of its component of links.

1. Equal sets become one row (a representative), whatever their number.
2. A set of n shingles can miss at most q = n - ceil(percent * n / 100) of a
   linked set's. Under any order of all shingles, of two linked sets' common ones
   the first spare + 1 are among the first q + 1 + ``spare`` of both: their low
   columns, by hash at first. The product over low columns that at most ``COMMON``
   sets share adds up overlap counts, and pairs below that bound, less the crowded
   columns they might share besides, are discarded.
   Sets are crowded if more than ``spare`` of their low columns have more sets than
   ``COMMON`` (shared passages, large groups of near copies). Crowded sets
   are met with one another once more, with the rarest shingles as low columns;
   those that are crowded still are tied to the least set of each crowded column
   within a class of sizes: stars, never all pairs. Sizes of linked
   sets differ by at most one class; each set is in its own and the next.
3. The components of the pairs, and those of the stars of each class, bound the full
   product: every linked pair lies within one. Components beyond one block are parted first where parities of their sets' shingles,
   a fiftieth of the sets, rule links out (``graph.refined``). Large components are contracted by the sets that link to a few of
   their members (``graph.spanned``); what is left is cut into blocks of about ``BLOCK`` sets, and each pair of blocks
   is a product of its own.
4. A block product runs over column blocks of the incidence matrix and adds up
   overlap counts. Pairs that sizes rule out (the smaller set is less than
   ``percent`` of the larger) are discarded first, and after each column block
   those whose count and remaining columns cannot reach the least overlap.
5. Linked pairs leave a product as a spanning forest; components of those edges
   are the result.

No link between different sets is lost, no pair of equal sets is made, and no
document's partners are capped.

Nulls, ties: null and empty texts and texts of white space have no shingles
and are components of their own; rows with a null doc_id link with nothing and
have a null component_id. Repeated rows are returned once each; texts that
share a doc_id are linked each by its own set. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common, graph, tokens

BLOCK = 96
#: Postings beyond which a shingle counts as common.
COMMON = 64
#: Columns of the incidence matrix in a dense block of the product.
COLUMNS = 8192

#: Values that a task's sketch of frequent ones keeps: its error is below half of one row in ``graph.HOT``.
TRACKED = 4 * graph.HOT + 96

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, as signed 64-bit integers.

    Only A-Z change case and only the six ASCII white-space characters part words.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n) * _MIX[0])
        for i in range(n):
            out = _mixed(out * _MIX[0] + h[i : len(h) - n + 1 + i])
    return np.unique(out.view(np.int64))


def missable(n: int, percent: int) -> int:
    """Shingles that a set of n may lack of a linked set's."""
    return n + (-n * percent // 100)


def spare(n: int) -> int:
    return n * 3 // 100 + 2


def sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, t, n, the set's fingerprint v, the number of shingles it may leave out, and those it might post."""
    common.tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("spare", pa.int32()), ("low", pa.list_(pa.int64()))])

    def build(batches):
        for batch in batches:
            got = [shingles(t, words) for t in batch["text"].to_pylist()]
            low = [s[: missable(len(s), percent) + 1 + spare(len(s))] for s in got]
            v = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in got]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["t"], pa.array([len(s) for s in got], pa.int64()), pa.array(v, pa.int64()), pa.array([spare(len(s)) for s in got], pa.int32()), pa.array(low, pa.list_(pa.int64()))], schema=schema)

    rows = common.whole_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(tokens.released(build), "doc_id long, t long, n long, v long, spare int, low array<bigint>")


def met(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For sets (v, n, spare, low): pairs (a, b) by overlap counts, crowded sets (v, n), and ties (v, g, m) of shared columns."""
    posts = lists.select("v", "n", "spare", F.explode("low").alias("g"))
    shared = common.written(posts.groupBy("g").agg(F.count("v").alias("m")).where("m > 1"), "shared")
    ties = common.written(graph.attached(posts, shared, "g", size="m", most=0), "ties")
    rows = ties.groupBy("v").agg(F.first("n").alias("n"), F.first("spare").alias("s"), F.count_if(F.col("m") > COMMON).alias("h"))
    rows = common.written(rows, "tied")
    # At most COMMON rows a column: COMMON / 2 pairs a row, fewer as sizes rule most out.
    row = F.struct("v", "n", "s", "h")
    column = ties.where(F.col("m") <= COMMON).select("g", "v").join(rows, "v").groupBy("g").agg(F.sort_array(F.collect_list(row)).alias("vs"))

    def paired(x, i):
        fit = F.filter(F.slice("vs", i + 2, F.size("vs")), lambda y: 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
        bound = lambda y: F.greatest(F.lit(1), F.least(x["s"], y["s"]) + 1 - F.least(x["h"], y["h"])).cast("int")
        return F.transform(fit, lambda y: F.struct(x["v"].alias("a"), y["v"].alias("b"), bound(y).alias("least")))

    counts = column.select(F.explode(F.flatten(F.transform("vs", paired))).alias("p")).groupBy("p.a", "p.b", "p.least").agg(F.count(F.lit(1)).alias("k"))
    return counts.where("k >= least").select("a", "b"), rows.where("h > s").select("v", "n"), ties.select("v", "g", "m")


def frequent(rows: DataFrame, column: str) -> list[int]:
    """Every value that holds more than one row in ``graph.HOT``, among fewer than twice as many; by a sketch, without a shuffle of rows."""
    # Its counts are upper bounds, by less than half a row in ``graph.HOT``.
    found = rows.agg(F.expr(f"approx_top_k({column}, {2 * graph.HOT}, {TRACKED})").alias("top"), F.count(column).alias("n")).first()
    return [x["item"] for x in found["top"] if x["count"] * graph.HOT > found["n"]]


@common.tidy
def rarest(docs: DataFrame, reps: DataFrame, some: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the sets in ``some`` (v): v, n, spare and as low columns the shingles that fewest of them hold, ties by hash, hot ones last."""
    chosen = common.written(reps.select("v", "doc_id", "n", "spare").join(some.select("v"), "v"), "chosen")
    text = common.whole_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def build(batches):
        for batch in batches:
            got = [shingles(t, words) for t in batch["text"].to_pylist()]
            v = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in got], np.int64)
            out = pa.RecordBatch.from_arrays([batch["v"], batch["n"], batch["spare"], pa.array(got, pa.list_(pa.int64()))], names=["v", "n", "spare", "all"])
            yield out.filter(pa.array(v == batch["v"].to_numpy()))

    rows = graph.attached(text, chosen, "doc_id").select("v", "n", "spare", "text")
    rows = rows.mapInArrow(tokens.released(build), "v long, n long, spare int, all array<bigint>").select("v", "n", "spare", F.explode("all").alias("g"))
    rows = common.written(rows, "shingles")
    # Any order of the shingles will do that all sets share: hot ones come last, by hash. They are dealt over
    # all tasks; the others' sets are counted where they lie, so no row is shuffled twice or joined.
    hot = F.col("g").isin(frequent(rows, "g"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("k", F.when(hot, F.pmod(F.xxhash64("v"), F.lit(parts))).otherwise(0).cast("int"))
    held = F.count(F.lit(1)).over(Window.partitionBy("g", "k"))
    rows = rows.withColumn("m", F.when(hot, F.lit(2**62)).otherwise(held))
    ranked = F.array_sort(F.array_distinct(F.collect_list(F.struct("m", "g"))))
    lists = rows.groupBy("v").agg(F.first("n").alias("n"), F.first("spare").alias("spare"), ranked.alias("all"))
    most = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 + F.col("spare")).cast("int")
    return common.written(lists.select("v", "n", "spare", F.slice(F.col("all.g"), F.lit(1), most).alias("low")), "rarest", "none")


@common.tidy
def candidates(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Groups (v, c) of ``reps`` (v, doc_id, n, spare, low); every linked pair is in one."""
    by_hash, crowded, _ = met(reps, percent)
    by_count, crowded, ties = met(rarest(docs, reps, crowded, words, percent), percent)
    pairs = graph.components(by_hash.unionByName(by_count))
    crowded = crowded.select("v", F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int").alias("k"))
    crowded = crowded.select("v", F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"))
    members = common.written(ties.where(F.col("m") > COMMON).select("v", "g").join(crowded, "v"), "crowded")
    least = common.written(members.groupBy("g", "k").agg(F.min("v").alias("b"), F.count("v").alias("n")), "least")
    named = graph.attached(members, least, ["g", "k"], size="n", most=0).where("v != b").select(F.xxhash64("v", "k").alias("a"), F.xxhash64("b", "k").alias("b"))
    classes = graph.components(named).withColumnRenamed("v", "w")
    inside = crowded.withColumn("w", F.xxhash64("v", "k")).join(classes, "w").select("v", F.xxhash64("c", F.lit(1)).alias("c"))
    return common.written(pairs.select("v", "c").unionByName(inside), "groups")


def product(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Linked pairs between the ``left`` and the ``right`` rows (or within ``left`` where they are the same)."""
    n = np.array([len(r) for r in rows], dtype=np.int64)
    a, b = n[left][:, None], n[right][None, :]
    # overlap >= percent * (a + b) / (100 + percent), rounded up
    need = -(-(a + b) * percent // (100 + percent))
    alive = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    same = left is right
    if same:
        alive &= np.triu(np.ones_like(alive), 1)
    if not alive.any():
        return []
    hashes, col = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), n)
    # Columns of a single row add to no overlap.
    degree = np.bincount(col, minlength=len(hashes))
    keep = degree[col] > 1
    rank = np.cumsum(degree > 1) - 1
    col, owner = rank[col[keep]], owner[keep]
    by_col = np.argsort(col, kind="stable")
    col, owner = col[by_col], owner[by_col]
    width = int(rank[-1]) + 1 if len(rank) else 0
    rest = np.bincount(owner, minlength=len(rows))
    counts = np.zeros(alive.shape, dtype=np.float32)
    spot = np.full(len(rows), -1)
    spot[left] = np.arange(len(left))
    other = np.full(len(rows), -1)
    other[right] = np.arange(len(right))
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(col, (at, at + COLUMNS))
        c, o = col[lo:hi] - at, owner[lo:hi]
        x = np.zeros((len(left), min(COLUMNS, width - at)), dtype=np.float32)
        y = x if same else np.zeros((len(right), x.shape[1]), dtype=np.float32)
        on = spot[o] >= 0
        x[spot[o[on]], c[on]] = 1
        if not same:
            on = other[o] >= 0
            y[other[o[on]], c[on]] = 1
        counts += x @ y.T
        rest = rest - np.bincount(o, minlength=len(rows))
        alive &= counts + np.minimum(rest[left][:, None], rest[right][None, :]) >= need
        if not alive.any():
            return []
    i, j = np.nonzero(alive & (counts >= need))
    return list(zip(left[i].tolist(), right[j].tolist()))


@common.tidy
def linked(docs: DataFrame, reps: DataFrame, groups: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """Edges (a, b) that span the links within each group (v, c) of representatives."""
    schema = pa.schema([("v", pa.int64()), ("c", pa.int64()), ("own", pa.int32()), ("blocks", pa.int32()), ("open", pa.int32()), ("row", pa.binary())])
    text = common.whole_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def build(batches):
        for batch in batches:
            got = [shingles(t, words) for t in batch["text"].to_pylist()]
            v = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in got], np.int64)
            ok = v == batch["v"].to_numpy()  # doc_id may stand for several texts
            out = pa.RecordBatch.from_arrays([*(batch[c] for c in ("v", "c", "own", "blocks", "open")), pa.array([s.tobytes() for s in got], pa.binary())], schema=schema)
            yield out.filter(pa.array(ok))

    def outline(batches):
        for batch in batches:
            got = [shingles(t, words) for t in batch["text"].to_pylist()]
            v = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in got], np.int64)
            ok = v == batch["v"].to_numpy()
            out = pa.RecordBatch.from_arrays([batch["v"], pa.array([graph.sketch(s, len(s)) for s in got], pa.binary())], names=["v", "row"])
            yield out.filter(pa.array(ok))

    def sketches(members):
        chosen = common.written(members.join(reps.select("v", "doc_id"), "v"), "outlined")
        held = graph.attached(text, chosen, "doc_id").select("text", "v").mapInArrow(tokens.released(outline), "v long, row binary")
        return held.dropDuplicates(["v"])  # rows may repeat

    def bound(a, b):
        return np.where(100 * np.minimum(a, b) >= percent * np.maximum(a, b), a + b - 2 * -(-(a + b) * percent // (100 + percent)), -1)

    def rows(cells):
        chosen = common.written(cells.join(reps.select("v", "doc_id"), "v"), "placed")
        held = graph.attached(text, chosen, "doc_id")
        return held.select("text", "v", "c", "own", "blocks", "open").mapInArrow(tokens.released(build), "v long, c long, own int, blocks int, open int, row binary")

    def links(cells):
        return [product([np.frombuffer(x, np.int64) for x in held], left, right, percent) for held, left, right in cells]

    return graph.spanned(graph.refined(groups, BLOCK, parts, sketches, bound), BLOCK, parts, rows, links)


@common.tidy
def join(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, t (a hash of the text, which tells rows that share a doc_id apart), n_shingles, component_id and set_class of every document.

    ``set_class`` names the component by its sets, also where a doc_id stands for several texts; it is
    null for documents that link with nothing by definition.
    """
    parts = common.tune(docs.sparkSession)
    whole = common.written(sets(docs, words, percent), "sets")
    reps = whole.where("n > 0 AND doc_id IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "spare", "low")), F.count(F.lit(1)).alias("copies"))
    reps = common.written(reps, "reps", "none")
    groups = candidates(docs, reps, words, percent)
    found = graph.components(linked(docs, reps, groups, words, percent, parts))
    first = common.written(found.join(reps.select("v", "doc_id", "copies"), "v"), "first")
    least = common.written(first.groupBy("c").agg(F.min("doc_id").alias("m"), F.count("v").alias("n")), "least")
    named = common.written(graph.attached(first.select("v", "c", "copies"), least, "c", size="n").select("v", "c", "m", "copies"), "classes")
    # Equal sets have their least doc_id's class, sets alone in their class none but themselves: neither is joined unless it must be.
    equal = reps.where("copies > 1").join(named.select("v", "c", "m"), "v", "left").select("v", "c", F.coalesce("m", "doc_id").alias("m"), "copies")
    equal = common.written(equal.unionByName(named.where("copies = 1")), "equal")
    out = graph.attached(whole.select("doc_id", "t", "n", "v"), equal, "v", "left", size="copies", most=0)
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(linkable, F.coalesce("m", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(linkable, F.coalesce("c", "v")).alias("set_class"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose sets of three-word shingles agree to nine tenths."""
    return join(common.table(spark, sf_dir, "documents"), 3, 90).drop("t", "set_class")
