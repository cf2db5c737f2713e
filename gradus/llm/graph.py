"""Connected components of an edge list, joins with hot keys and comparisons within groups, as DataFrames."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, tokens


#: Edges that one task may hold (16 bytes each) to finish a graph.
FINISH_EDGES = 500_000


@common.tidy
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v`` and ``c``, the smallest vertex of its component, for every vertex on an edge.

    While there are more than ``FINISH_EDGES`` edges, a round maps every vertex to
    its least neighbour's least neighbour, renames the edges' ends so and drops
    those whose ends meet: the graph shrinks by more than half (its vertices are hashes,
    so chains that descend are short). The bounded rest is finished in one task. Every
    round is written to the shared folder: no lineage grows, and a lost
    executor costs one round.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = common.written(e.distinct(), "edges")
    labels = None
    while e.count() > FINISH_EDGES:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = common.written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "hop")
        jump = common.written(attached(hop, hop.select(F.col("v").alias("c"), F.col("c").alias("n")), "c").select("v", F.col("n").alias("c")), "jump")
        for end in "ab":
            e = attached(e, jump.select(F.col("v").alias(end), F.col("c").alias(f"c{end}")), end)
        e = common.written(e.where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "edges")
        common.dropped(hop)
        labels = jump if labels is None else _composed(labels, jump)
    last = common.written(e.coalesce(1).mapInArrow(_finished, "v long, c long"), "finish")
    common.dropped(e)
    return last if labels is None else _composed(labels, last)


def _composed(labels: DataFrame, over: DataFrame) -> DataFrame:
    over = over.select(F.col("v").alias("c"), F.col("c").alias("n"))
    return common.written(attached(labels, over, "c", "left").select("v", F.coalesce("n", "c").alias("c")), "labels")


def _finished(batches):
    ends = [[], []]
    for batch in batches:
        for k in (0, 1):
            ends[k].append(batch.column(k).to_numpy())
    if not ends[0]:
        return
    n = sum(map(len, ends[0]))
    names, place = np.unique(np.concatenate(ends[0] + ends[1]), return_inverse=True)
    root = _roots(len(names), place[:n], place[n:])
    for at in range(0, len(names), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000]), pa.array(names[root[at : at + 10_000]])], names=["v", "c"])


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``size`` vertices' component under the edges."""
    root = np.arange(size)
    while True:
        one, other = root[a], root[b]
        open_ = one != other
        if not open_.any():
            return root
        a, b, one, other = a[open_], b[open_], one[open_], other[open_]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]


#: Rows of at most a few dozen bytes that a broadcast may hold.
BROADCAST_ROWS = 500_000


#: A key is hot if it holds more than one in so many rows; fewer keys than that can.
HOT = 1000


def attached(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", size: str | None = None, most: int | None = None) -> DataFrame:
    """``big`` joined with ``small``, a written table of narrow rows: by broadcast if it is counted small (``most`` rows), else by shuffle.

    Beyond that bound, the rows of hot keys stay where they are: what ``small`` has for
    those (fewer than ``HOT`` keys) is broadcast, and only the rest is shuffled. ``size`` names a column of
    ``small`` with the number of rows of ``big`` for its key, where that is known.
    """
    most = BROADCAST_ROWS if most is None else most
    if most and small.count() <= most:
        return big.join(F.broadcast(small), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    if size:
        total = small.agg(F.sum(size)).first()[0] or 0
        hot = small.where(F.col(size) * HOT > total).select(*keys)
    else:
        counts = common.written(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "keys")
        total = counts.agg(F.sum("__n")).first()[0] or 0
        hot = counts.where(F.col("__n") * HOT > total).select(*keys)
    # After a shuffle: the scan of all counts stays with its own tasks.
    hot = common.written(hot.na.drop().repartition(1), "hot")
    if hot.isEmpty():
        return big.join(small, on, how)
    there = big.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(small.join(F.broadcast(hot), on, "left_semi")), on, how)
    return there.unionByName(big.join(F.broadcast(hot), on, "left_anti").join(small, on, how))


#: Rows and bytes of cells that are worked on side by side.
CELL_ROWS, CELL_BYTES = 2048, 4 << 20


def within_groups(rows: DataFrame, parts: int, links) -> DataFrame:
    """Edges (a, b) that span the links within groups of rows (v, c, own, blocks, open, row).

    ``c`` is the group, ``row`` what is compared (binary), ``own`` its block of the
    group's ``blocks``, of which the first ``open`` are compared with all and the others with those only.
    Every such pair of blocks is a cell that one task
    works on alone, so no group, whatever its size, is gathered in one place.
    ``links`` takes cells (rows, left, right) and gives for each the linked pairs
    between the two index arrays (the same array twice: the pairs within it).
    """
    last = F.when(F.col("own") < F.col("open"), F.col("blocks")).otherwise(F.col("open")) - 1
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("mate")).select("v", "c", "own", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"), "row")
    cells = cells.repartition(parts, "c", "i", "j").sortWithinPartitions("c", "i", "j", "own", "v")

    def solve(batches):
        key, v, held, own, size = None, [], [], [], [0, 0]
        ready: list = []

        def close():
            if len(v) > 1:
                where = np.array(own)
                left = np.flatnonzero(where == key[1])
                ready.append((v, (held, left, left if key[1] == key[2] else np.flatnonzero(where == key[2]))))
                size[0] += len(v)
                size[1] += sum(map(len, held))

        def solved():
            out = ([], [])
            for (names, cell), found in zip(ready, links([cell for _, cell in ready])):
                for k, r in enumerate(forest(len(names), found)):
                    if r != k:
                        out[0].append(names[k])
                        out[1].append(names[r])
            ready.clear()
            size[:] = 0, 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

        for batch in batches:
            for name, c, o, i, j, row in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, i, j) != key:
                    close()
                    key, v, held, own = (c, i, j), [], [], []
                    if size[0] >= CELL_ROWS or size[1] >= CELL_BYTES:
                        yield solved()
                if v and v[-1] == name and own[-1] == o:
                    continue  # the same row again
                v.append(name)
                own.append(o)
                held.append(row)
        close()
        yield solved()

    return cells.mapInArrow(tokens.released(solve), "a long, b long")


def placed(groups: DataFrame, block: int, first: int = 0) -> DataFrame:
    """Groups (v, c, size) with each row's block of about ``block`` rows, from ``first`` on, and their number."""
    # The place within a group is a hash's: blocks need only be about even.
    blocks = F.ceil(F.col("size") / block).cast("int")
    return groups.select("v", "c", (F.lit(first) + F.pmod(F.xxhash64("v"), blocks.cast("long"))).cast("int").alias("own"), (F.lit(first) + blocks).alias("blocks"), F.lit(first or 1).alias("open"))


#: Blocks from which a group is contracted by pivots first; pivots of a group in a turn, and turns at most.
CONTRACTED, PIVOTS, TURNS = 16, 4, 3


@common.tidy
def spanned(groups: DataFrame, block: int, parts: int, rows, links) -> DataFrame:
    """Edges (a, b) that span the links within groups (v, c); ``rows`` adds to groups in blocks what ``links`` compares.

    A large group is met with a few of its members first, turn by turn: members linked to those
    directly or through one another are one set, and need no comparison among
    themselves any more. Only what the largest set of a group leaves over is compared with all of
    the group, block by block. A group of near copies costs time in proportion to its size.
    """
    count = common.written(groups.groupBy("c").agg(F.count("v").alias("size")), "sizes")
    sized = common.written(attached(groups, count, "c", size="size"), "sized")
    few = F.ceil(F.col("size") / block) < CONTRACTED
    small = placed(sized.where(few), block).withColumn("open", F.col("blocks"))
    edges = [common.written(within_groups(rows(small), parts, links), "edges")]
    big = sized.where(~few)
    if big.isEmpty():
        return edges[0]
    loose = big
    for turn in range(TURNS):
        pivots = loose.groupBy("c", F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(PIVOTS)).alias("k")).agg(F.min("v").alias("v"), F.first("size").alias("size"))
        cells = placed(pivots, block, 1).withColumn("own", F.lit(0)).unionByName(placed(big, block, 1))
        edges.append(common.written(within_groups(rows(common.written(cells, "cells")), parts, links), "edges"))
        sets = components(reduce(DataFrame.unionByName, edges[1:])).withColumnRenamed("c", "m")
        named = common.written(attached(big, sets, "v", "left").withColumn("m", F.coalesce("m", "v")), "named")
        main = named.groupBy("c", "m").agg(F.count("v").alias("n")).groupBy("c").agg(F.max_by("m", F.struct("n", "m")).alias("main"), F.sum("n").alias("size"))
        loose = common.written(attached(named.drop("size"), common.written(main, "main"), "c", size="size").where("m != main").select("v", "c", "size"), "loose")
        if loose.isEmpty():
            return reduce(DataFrame.unionByName, edges)
    # Loose members in the first blocks, those of the largest set in the others.
    left = common.written(loose.groupBy("c").agg(F.count("v").alias("n")), "left")
    rest = attached(named, left, "c").join(loose.select("v", "c", F.lit(1).alias("is_loose")), ["v", "c"], "left")
    first, others = F.ceil(F.col("n") / block).cast("int"), F.ceil((F.col("size") - F.col("n")) / block).cast("int")
    own = F.when(F.col("is_loose") == 1, F.pmod(F.xxhash64("v"), first.cast("long"))).otherwise(first + F.pmod(F.xxhash64("v"), F.greatest(others, F.lit(1)).cast("long"))).cast("int")
    cells = common.written(rest.select("v", "c", own.alias("own"), (first + others).alias("blocks"), first.alias("open")), "cells")
    edges.append(common.written(within_groups(rows(cells), parts, links), "edges"))
    return reduce(DataFrame.unionByName, edges)


#: Rows of a block of sketches, bits of a sketch at least and at most, and words of sketches that are compared at once.
WIDE, BITS, WORDS = 512, (256, 1 << 15), 1 << 20


def sketch(grams: np.ndarray, n: int) -> bytes:
    """``n`` and the parities of the grams (hashes) in about as many buckets as there are grams.

    A gram that one of two rows has once more than the other changes one parity, so no more parities differ than such grams.
    """
    bits = min(BITS[1], max(BITS[0], 1 << max(0, len(grams) - 1).bit_length()))
    odd = np.bincount((grams.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return n.to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def alike(cells: list[tuple[list[bytes], np.ndarray, np.ndarray]], bound) -> list[list[tuple[int, int]]]:
    """For cells of sketches: pairs that span those whose parities differ in no more than ``bound`` grams.

    ``bound`` takes the ``n`` of two rows (arrays) and gives the most grams that linked ones differ in, or -1 if their ``n`` rule a link out.
    """
    out = []
    for held, left, right in cells:
        n, wide = np.array([int.from_bytes(x[:8], "little") for x in held]), np.array([len(x) - 8 for x in held])
        most = bound(n[left][:, None], n[right][None, :])
        if left is right:
            most = np.where(np.triu(np.ones(most.shape, bool), 1), most, -1)
        i, j = np.nonzero(most >= 0)
        most = most[i, j]
        i, j = left[i], right[j]
        narrow, a, b = np.minimum(wide[i], wide[j]), [], []
        for width in np.unique(narrow).tolist():
            own = np.flatnonzero(narrow == width)
            # A sketch of more buckets is folded to as many as the other's.
            rows = np.unique(np.concatenate((i[own], j[own])))
            folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(held[r], "<u8", offset=8).reshape(-1, width // 8), axis=0) for r in rows])
            x, y = np.searchsorted(rows, i[own]), np.searchsorted(rows, j[own])
            step = max(1, WORDS // (width // 8))
            for at in range(0, len(own), step):
                part = slice(at, at + step)
                near = np.bitwise_count(folded[x[part]] ^ folded[y[part]]).sum(axis=1, dtype=np.int64) <= most[own[part]]
                a.append(i[own[part]][near])
                b.append(j[own[part]][near])
        root = _roots(len(held), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(held))
        apart = np.flatnonzero(root != np.arange(len(held)))
        out.append(list(zip(apart.tolist(), root[apart].tolist())))
    return out


@common.tidy
def refined(groups: DataFrame, block: int, parts: int, sketches, bound) -> DataFrame:
    """Groups (v, c) of which those beyond one block are parted where sketches show that no link can be.

    ``sketches`` takes members (v) and gives v and row (``sketch``). A sketch is a small share of what it stands for and a
    block of them holds more rows, so groups of unlike rows are parted before their rows are sent once for each block they have.
    """
    count = common.written(groups.groupBy("c").agg(F.count("v").alias("size")).where(F.col("size") > block), "large")
    if count.isEmpty():
        return groups
    large = common.written(attached(groups, count, "c", size="size").select("v", "c"), "members")
    held = common.written(sketches(large.select("v").distinct()), "sketches")

    def rows(cells):
        return cells.join(held, "v").select("v", "c", "own", "blocks", "open", "row")

    found = components(spanned(large, WIDE, parts, rows, lambda cells: alike(cells, bound)))
    small = attached(groups, count.select("c"), "c", "left_anti").select("v", "c")
    return common.written(small.unionByName(found.select("v", F.xxhash64("c", F.lit(2)).alias("c"))), "refined")


def forest(size: int, links: list[tuple[int, int]]) -> list[int]:
    """The least member of each row's set under the links."""
    root = list(range(size))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in links:
        i, j = top(i), top(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [top(x) for x in range(size)]
