"""Operator 11: filter interaction audit, with duplicates by partition refinement.

A document's mask has a bit for each of five filters that it fails:

* A: under 50 words (maximal runs without ASCII white space); B: 100 * distinct words < 65 * words;
* C: 100 * capital letters A-Z > 5 * code points; D: one of ``#$%&*|``;
* E: its text is identical to that of a smaller doc_id anywhere in the table.

E comes from refining a partition of all documents: they are split by
code-point length, then by the hash of one block of text after the other (block ends in
``ENDS``, so a text has few blocks however long it is), and classes of one document leave the
game after each split. What survives every split is compared by its full text, and
each text's members but those with the least doc_id fail E. Splits work on
narrow rows; a class, however large, is counted before its shuffle and its count
attached without gathering it (``graph.attached``). Full texts are read again only for the
comparison, whose copies also meet their minimum before the shuffle.

With masks, nothing else needs a document: counts by part, mask and label settle all 120 orders of
the filters, because a document leaves at the first filter of the order whose bit it
has. Over all orders a filter that shares a document with m - 1 others is its first in 120 / m
of them, which is ``shapley`` exactly.

Nulls, ties: a null text is the empty text and a null source the part ''. Documents
without doc_id are neither smaller than another nor larger, so they never fail E and make no other
fail it. Rows of the same doc_id and text do not make each other fail. A document whose labels
repeat counts as good (toxic) if one of them says so; labels without
doc_id are not used. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, graph

FILTERS = "ABCDE"
#: Code points at which the blocks of a text end; the last block takes the rest.
ENDS = (128, 2048, 32_768, 524_288, 8_388_608)
#: ASCII white space.
_GAP = r"[\x20\x09-\x0D]+"
_MASKS = 1 << len(FILTERS)


def failures(text: Column) -> Column:
    """Bits of A to D."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    size, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (size < 50, kinds * 100 < size * 65, capitals.cast("long") * 100 > F.length(text).cast("long") * 5, text.rlike(r"[#$%&*|]"))
    return sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))


def blocks(text: Column, ends=ENDS) -> Column:
    """A hash of each block that a text reaches."""
    starts = (0, *ends)
    own = [F.when(F.length(text) > a, F.xxhash64(F.substring(text, a + 1, (b - a) if b else 2**31 - 1))) for a, b in zip(starts, (*ends, None))]
    return F.array_compact(F.array(*own))


def keyed(length: Column, hashes: Column, turns: int | None = None) -> Column:
    """The class after so many splits (all of them): the length, hashed with one block after the other."""
    own = hashes if turns is None else F.slice(hashes, 1, turns)
    return F.aggregate(own, length.cast("long"), lambda key, h: F.xxhash64(key, h))


def refined(rows: DataFrame, ends=ENDS) -> DataFrame:
    """key and n, the classes of two documents or more after every split of ``rows`` (length, hashes)."""
    live = rows.select("length", "hashes")
    for turn in range(len(ends) + 2):
        live = live.withColumn("key", keyed(F.col("length"), F.col("hashes"), turn))
        sizes = common.written(live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("hashes")).alias("blocks")), "classes")
        kept = common.written(sizes.where("n > 1"), "kept")
        if kept.where(F.col("blocks") > turn).isEmpty():
            break
        live = common.written(graph.attached(live, kept.select("key", "n"), "key", size="n").select("length", "hashes"), "live")
    return kept.select("key", "n")


@common.tidy
def copies(docs: DataFrame, narrow: DataFrame, ends=ENDS) -> DataFrame:
    """key, digest (null but where several texts share a key) and first, the least doc_id of each text that occurs under two rows or more.

    ``narrow`` has doc_id, length and hashes of ``docs`` (doc_id, text).
    """
    kept = refined(narrow.where("doc_id IS NOT NULL").select("length", "hashes"), ends)
    text = docs.where("doc_id IS NOT NULL").select("doc_id", "text", keyed(F.length("text"), blocks(F.col("text"), ends)).alias("key"))
    alike = graph.attached(text, kept, "key", size="n").groupBy("key", "text").agg(F.min("doc_id").alias("first"))
    alike = common.written(alike.select("key", F.sha2("text", 256).alias("digest"), "first"), "alike")
    single = alike.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).where("texts = 1").select("key", F.lit(None).cast("string").alias("digest"), "first")
    clashing = alike.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key")
    return common.written(single.unionByName(alike.join(clashing, "key", "left_semi").select("key", "digest", "first")), "copies")


@common.tidy
def masked(docs: DataFrame, ends=ENDS) -> DataFrame:
    """doc_id, part and mask of every row of ``docs`` (doc_id, text, source)."""
    common.tune(docs.sparkSession)
    docs = common.whole_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    narrow = docs.select("doc_id", "part", failures(F.col("text")).alias("mask"), F.length("text").alias("length"), blocks(F.col("text"), ends).alias("hashes"))
    narrow = common.written(narrow, "masks")
    found = copies(docs, narrow, ends)
    rows = narrow.withColumn("key", keyed(F.col("length"), F.col("hashes"))).drop("length", "hashes")
    clash = found.where("digest IS NOT NULL")
    later = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    if clash.isEmpty():
        least = found.select("key", "first")
    else:
        # Texts under one key: their rows are told apart by digest, which only these need.
        text = docs.select("doc_id", "part", failures(F.col("text")).alias("mask"), "text", keyed(F.length("text"), blocks(F.col("text"), ends)).alias("key"))
        keys = common.written(clash.select("key").distinct(), "clashing")
        apart = graph.attached(text, keys, "key", "left_semi").withColumn("digest", F.sha2("text", 256)).drop("text")
        apart = graph.attached(apart, clash, ["key", "digest"], "left").withColumn("mask", F.col("mask") + later)
        rows, least = graph.attached(rows, keys, "key", "left_anti"), common.written(found.where("digest IS NULL").select("key", "first"), "least")
    rows = graph.attached(rows, least, "key", "left").withColumn("mask", F.col("mask") + later)
    out = rows.select("doc_id", "part", "mask")
    return common.written(out if clash.isEmpty() else out.unionByName(apart.select("doc_id", "part", "mask")), "masked")


def steps(parts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``parts`` with filter_order, step, the step's bit and the bits before it: a row for every order and step."""
    every = F.split(F.lit(",".join("".join(p) for p in permutations(filters))), ",")
    rows = parts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bits = F.transform(F.split("filter_order", ""), lambda f: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(filters), f) - 1))
    before = F.aggregate(F.slice(bits, 1, F.col("step") - 1), F.lit(0), lambda a, x: a.bitwiseOR(x))
    return rows.withColumns({"bit": F.get(bits, F.col("step") - 1), "before": before})


@common.tidy
def audit(docs: DataFrame, labels: DataFrame, ends=ENDS) -> DataFrame:
    """part, filter_order, step and the seven counts of each."""
    # A document of one mask is one row, however often it occurs; labels then meet one row a document, part and mask.
    rows = masked(docs, ends).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = rows.join(marks.where("good = 1 OR toxic = 1"), "doc_id", "left")
    counts = marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # At most 32 masks a part.
    parts = common.written(counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "parts")

    def total(column: str, test) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda out, c: out + F.when(test(c["mask"]), c[column]).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    shares = F.array(*(F.lit(120 // bin(m).count("1") if m else 0) for m in range(_MASKS)))
    own = F.aggregate("cells", F.lit(0).cast("long"), lambda out, c: out + F.when(c["mask"].bitwiseAND(bit) != 0, c["n"] * F.get(shares, c["mask"])).otherwise(0))
    return steps(parts).select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        own.alias("shapley"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over ``documents``, by source."""
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
