"""Operator 9: mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic; a cell's mass
is its tokens (words between white space). Fitting rakes the cells' weights
until the weighted token shares of every source, language and topic meet their
targets, or as nearly as the cells that exist allow. A document is then kept
with probability min(1, scale * weight of its cell), the scale being set so that the
expected tokens are ``keep`` of all; a hash of the document decides, so a run
can be repeated.

Targets default to the observed shares raised to ``temper`` and normalised,
which lifts small sources, languages and topics against large ones. Topics are
the nearest of ``TOPICS`` centres of hashed word counts, fitted by spherical
k-means over all documents; it starts from the centres of at most ``SAMPLE`` of
them in the order of a hash of doc_id. A round sums fixed-point numbers, so its
result does not depend on the partitions.

The cells are many times fewer than documents, yet sources may be unboundedly
many: up to ``CELLS`` of them are raked on the driver, beyond that by
DataFrame aggregations with the same arithmetic.

Nulls, ties: a null source or language is a class of its own; null and empty
texts have no tokens and topic 0, and are kept with their cell's probability;
repeated rows with the same doc_id and text share one fate. Other columns are
passed on. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

TOPICS, BINS, SAMPLE = 8, 256, 4096
CELLS = 200_000
#: Fixed point of the sums of unit bins.
FIXED = 1 << 28
ROUNDS, PRECISION, BISECTIONS = 100, 1e-9, 100
MARGINS = ("source", "lang", "topic")
TEMPER, KEEP = 0.5, 0.5


def word_bins(text: str) -> tuple[np.ndarray, int]:
    """Square roots of hashed word counts, and the number of words."""
    words = text.split()
    places = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % BINS
    return np.sqrt(np.bincount(places, minlength=BINS)), len(words)


def packed(text: str) -> bytes:
    """Hashed word counts: a byte each where all fit, else four."""
    counts = np.rint(word_bins(text)[0] ** 2)
    return counts.astype("u1" if counts.max() < 256 else "<i4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Square roots of the counts, a row each."""
    out = np.empty((len(rows), BINS))
    for size, kind in ((BINS, "u1"), (4 * BINS, "<i4")):
        own = [i for i, r in enumerate(rows) if len(r) == size]
        if own:
            out[own] = np.frombuffer(b"".join(rows[i] for i in own), kind).reshape(-1, BINS)
    return np.sqrt(out, out=out)


@common.tidy
def centres(docs: DataFrame, rows: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit topic centres of all documents: rounds of k-means from the centres of a bounded sample."""
    c = starting(docs, rows, rounds)

    @F.arrow_udf("binary")
    def bins(texts: pa.Array) -> pa.Array:
        return pa.array([packed(t or "") for t in texts.to_pylist()], pa.binary())

    x = common.written(docs.select(bins("text").alias("x")), "bins")
    for _ in range(rounds):
        new = moved(x, c)
        if (new == c).all():
            break
        c = new
    common.dropped(x)
    return c


def moved(x: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centres after a round over all word counts; one without documents stays."""

    def tally(batches):
        total = np.zeros(c.shape, dtype=np.int64)
        for batch in tokens.gathered(batches, "x"):
            rows = unpacked(batch["x"].to_pylist())
            rows = rows[rows.any(axis=1)]
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            own = (rows @ c.T).argmax(axis=1)
            for k in range(len(c)):
                total[k] += np.rint(rows[own == k] * FIXED).astype(np.int64).sum(axis=0)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(total[k, b])], names=["k", "b", "s"])

    out = np.zeros(c.shape)
    for k, b, s in x.mapInArrow(tokens.released(tally), "k long, b long, s long").groupBy("k", "b").agg(F.sum("s")).collect():
        out[k, b] = s
    some = out.any(axis=1)
    out[some] /= np.linalg.norm(out[some], axis=1, keepdims=True)
    out[~some] = c[~some]
    return out


def starting(docs: DataFrame, rows: int, rounds: int) -> np.ndarray:
    """Unit topic centres of a bounded sample; the sample's bins, not its texts, reach the driver."""
    ids = docs.select(F.col("doc_id").cast("long").alias("sampled")).where("sampled IS NOT NULL").distinct().orderBy(F.xxhash64("sampled"), "sampled").limit(rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("sampled"), "text").join(F.broadcast(ids), "sampled")

    @F.arrow_udf("array<float>")
    def bins(texts: pa.Array) -> pa.Array:
        return pa.array([word_bins(t or "")[0].astype(np.float32) for t in texts.to_pylist()], pa.list_(pa.float32()))

    x = np.array([r["x"] for r in picked.select("sampled", bins("text").alias("x")).orderBy("sampled").limit(rows).collect()], dtype=np.float64).reshape(-1, BINS)
    x = x[x.any(axis=1)]
    if not len(x):
        return np.eye(TOPICS, BINS)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(TOPICS, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def classified(docs: DataFrame, topics: np.ndarray, column: str = "mix") -> DataFrame:
    """``docs`` with a struct of topic and tokens in ``column``."""

    @F.arrow_udf("topic int, tokens long")
    def judge(texts: pa.Array) -> pa.Array:
        got = [word_bins(t or "") for t in texts.to_pylist()]
        x = np.array([g[0] for g in got]).reshape(-1, BINS)
        topic = (x @ topics.T).argmax(axis=1) if len(x) else []
        return pa.StructArray.from_arrays([pa.array(topic, pa.int32()), pa.array([g[1] for g in got], pa.int64())], names=["topic", "tokens"])

    return docs.withColumn(column, judge("text"))


def tempered(share: np.ndarray, temper: float) -> np.ndarray:
    out = np.where(share > 0, share, 0.0) ** temper * (share > 0)
    return out / out.sum() if out.sum() else out


def rake(codes: list[np.ndarray], mass: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, precision: float = PRECISION) -> np.ndarray:
    """Weights of the cells (``codes``: each margin's class of each cell) that bring the shares of mass to the targets."""
    w = np.ones(len(mass))
    total = mass.sum()
    if total <= 0:
        return w
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, targets):
            have = np.bincount(code, weights=w * mass, minlength=len(goal)) / total
            factor = np.divide(goal, have, out=np.ones_like(goal), where=have > 0)
            worst = max(worst, np.abs(have - goal).max())
            w *= factor[code]
        if worst < precision:
            break
    return w


def scale(w: np.ndarray, mass: np.ndarray, keep: float) -> float:
    """The scale at which the expected share of tokens kept is ``keep``."""
    total = mass.sum()
    some = (w > 0) & (mass > 0)
    low, high = 0.0, 1.0 / w[some].min() if some.any() else 1.0
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * w) * mass).sum() < keep * total else (low, mid)
    return high


def rake_frame(cells: DataFrame, temper: float, rounds: int = ROUNDS, precision: float = PRECISION) -> DataFrame:
    """``rake`` on DataFrames, for more cells than the driver takes: columns w and those of ``cells``."""
    total = cells.agg(F.sum("mass")).first()[0] or 0
    state = common.written(cells.withColumn("w", F.lit(1.0)), "rake")
    if not total:
        return state
    goals = {}
    for m in MARGINS:
        share = cells.groupBy(m).agg((F.sum("mass") / total).alias("have")).where("have > 0")
        norm = share.agg(F.sum(F.pow("have", F.lit(temper)))).first()[0]
        goals[m] = common.written(share.select(F.col(m).alias("m"), (F.pow("have", F.lit(temper)) / norm).alias("goal")), "goal")
    for _ in range(rounds):
        worst = 0.0
        for m in MARGINS:
            have = state.groupBy(F.col(m).alias("m")).agg((F.sum(F.col("w") * F.col("mass")) / total).alias("have"))
            both = common.written(have.join(goals[m], have["m"].eqNullSafe(goals[m]["m"])).select(have["m"], "have", "goal"), "margin")
            worst = max(worst, both.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0)
            new = state.join(both, state[m].eqNullSafe(both["m"]), "left").withColumn("w", F.col("w") * F.coalesce(F.when(F.col("have") > 0, F.col("goal") / F.col("have")), F.lit(1.0)))
            old, state = state, common.written(new.drop("m", "have", "goal"), "rake")
            common.dropped(old)
        if worst < precision:
            break
    return state


@common.tidy
def probabilities(docs: DataFrame, temper: float = TEMPER, keep: float = KEEP, most: int = CELLS) -> DataFrame:
    """source, lang, topic, weight and probability of each cell of ``docs`` (with ``mix``)."""
    cells = common.written(docs.groupBy("source", "lang", F.col("mix.topic").alias("topic")).agg(F.sum("mix.tokens").cast("double").alias("mass")), "cells")
    spark = docs.sparkSession
    if cells.count() <= most:
        rows = [tuple(r) for r in cells.orderBy(*MARGINS).collect()]
        mass = np.array([r[3] for r in rows], dtype=np.float64)
        codes, targets = [], []
        for m in range(3):
            names = {k: i for i, k in enumerate(sorted({r[m] for r in rows}, key=lambda x: (x is not None, x)))}
            codes.append(np.array([names[r[m]] for r in rows], dtype=np.int64))
            targets.append(tempered(np.bincount(codes[m], weights=mass, minlength=len(names)) / max(mass.sum(), 1e-300), temper))
        w = rake(codes, mass, targets)
        s = scale(w, mass, keep)
        kinds = [("source", pa.string()), ("lang", pa.string()), ("topic", pa.int32()), ("weight", pa.float64()), ("probability", pa.float64())]
        columns = [[r[k] for r in rows] for k in range(3)] + [w.tolist(), np.minimum(1.0, s * w).tolist()]
        # As Arrow: rows given as a list go through Python workers of another kind, which stay beside the others for minutes.
        return spark.createDataFrame(pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], schema=pa.schema(kinds)), "source string, lang string, topic int, weight double, probability double")
    raked = rake_frame(cells, temper)
    low, high = 0.0, raked.where("w > 0 AND mass > 0").agg(1 / F.min("w")).first()[0] or 1.0
    total = raked.agg(F.sum("mass")).first()[0]
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        got = raked.agg(F.sum(F.least(F.lit(1.0), F.col("w") * mid) * F.col("mass"))).first()[0]
        low, high = (mid, high) if got < keep * total else (low, mid)
    return raked.select(*MARGINS, F.col("w").alias("weight"), F.least(F.lit(1.0), F.col("w") * high).alias("probability"))


@common.tidy
def mixed(docs: DataFrame, temper: float = TEMPER, keep: float = KEEP, seed: int = 9, column: str = "mix") -> DataFrame:
    """``docs`` with in ``column`` a struct of topic, tokens, weight, probability and sampled."""
    common.tune(docs.sparkSession)
    own = classified(docs, centres(docs), column)
    small = common.written(own.select("source", "lang", F.col(column).alias("mix")), "mix")
    p = probabilities(small, temper, keep).select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("weight").alias("__weight"), F.col("probability").alias("__probability"))
    p = common.written(p, "probabilities")
    p = F.broadcast(p) if p.count() <= CELLS else p
    on = F.col("source").eqNullSafe(F.col("__source")) & F.col("lang").eqNullSafe(F.col("__lang")) & (F.col(f"{column}.topic") == F.col("__topic"))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce("text", F.lit(""))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    mix = F.struct(f"{column}.topic", f"{column}.tokens", F.col("__weight").alias("weight"), F.col("__probability").alias("probability"), (chance < F.col("__probability")).alias("sampled"))
    return own.join(p, on, "left").withColumn(column, mix).drop("__source", "__lang", "__topic", "__weight", "__probability")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, probabilities and the sample of ``documents`` at half of its tokens."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixed(docs).select("doc_id", "source", "lang", "mix.*")
