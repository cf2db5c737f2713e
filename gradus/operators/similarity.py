"""BLEU-style similarity, counted inside each row.

Both texts of a pair lie in one row, so their n-grams are counted there, in Arrow
batches: no n-gram is shuffled. What leaves a row are numerators, denominators and
lengths; corpus scores are sums of those, and scores are column expressions over them.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import brevity_penalty, ngrams
from ..functions.strings import tokens
from ..session import ship

ORDERS = 4
EPSILON, ALPHA, K = 0.1, 5.0, 5.0
#: Rows of a batch that are Python values at a time.
TOGETHER = 16


def grams(rows: DataFrame, text: str, orders: int = ORDERS) -> DataFrame:
    """pair_id, n, gram and count of a text's n-grams, one row each: for joins on n-grams themselves."""
    words = rows.select("pair_id", tokens(F.col(text)).alias("w"))
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.transform(ngrams(F.col("w"), n), lambda g: F.array_join(g, " ")).alias("g")) for n in range(1, orders + 1)))
    long = words.select("pair_id", F.explode(each).alias("e")).select("pair_id", "e.n", F.explode("e.g").alias("gram"))
    return long.groupBy("pair_id", "n", "gram").agg(F.count(F.lit(1)).alias("k"))


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    """A batch's rows as Python values, a few at a time: all words of a batch at once take many times its size."""
    for at in range(0, len(columns[0]), TOGETHER):
        yield from zip(*(c.slice(at, TOGETHER).to_pylist() for c in columns))


def counted(words: list[str], n: int) -> Counter:
    """How often each n-gram occurs."""
    return Counter(words if n == 1 else zip(*(words[i:] for i in range(n))))


def clipped(hypothesis: list[str], references: list[list[str]], orders: int) -> list[int]:
    """For each order the n-grams of the hypothesis, each at most as often as in the reference that has it most often."""
    out = []
    for n in range(1, orders + 1):
        own, best = counted(hypothesis, n), Counter()
        for r in references:
            best |= counted(r, n)
        out.append(sum(min(k, best[g]) for g, k in own.items() if g in best))
    return out


def references(pairs: DataFrame) -> Column:
    """The references as an array: column ``references``, or the one in ``reference``."""
    return F.col("references") if "references" in pairs.columns else F.array("reference")


def matches(pairs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """pair_id, hyp_len, ref_len and for each order num_n and den_n (clipped matches, at least 1).

    ``pairs`` has pair_id, hypothesis and reference, or an array ``references``; ref_len is that of the
    reference nearest in length, the shorter of two equally near.
    """
    ship(pairs.sparkSession)
    names = ["hyp_len", "ref_len", *(f"num_{n}" for n in range(1, orders + 1))]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def count(hypotheses: pa.Array, others: pa.Array) -> pa.Array:
        rows = []
        for h, rs in _rows(hypotheses, others):
            near = min((len(r) for r in rs), key=lambda n: (abs(n - len(h)), n), default=0)
            rows.append((len(h), near, *clipped(h, rs, orders)))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)

    own = F.coalesce(tokens(F.col("hypothesis")), F.array().cast("array<string>"))
    other = F.transform(F.filter(references(pairs), lambda r: r.isNotNull()), lambda r: tokens(r))
    got = pairs.select("pair_id", count(own, other).alias("m")).select("pair_id", "m.*")
    return got.select("*", *(F.greatest(F.lit(1), F.col("hyp_len") - n + 1).cast("bigint").alias(f"den_{n}") for n in range(1, orders + 1)))


def smoothed(method: int, orders: int = ORDERS) -> list[Column]:
    """Modified precisions of matches() by smoothing 0 to 7, each order a column expression.

    5 and 7 need matches() of one order more. 4 (and 7) is null for a hypothesis of one word without
    matches of some order, whose length has no logarithm to divide by; 6 is null without a match of three words.
    """
    num = [F.col(f"num_{n}").cast("double") for n in range(1, orders + 1)]
    den = [F.col(f"den_{n}").cast("double") for n in range(1, orders + 1)]
    p = [a / b for a, b in zip(num, den)]
    none = F.lit(None).cast("double")
    if method == 0:
        return [F.when(a == 0, sys.float_info.min).otherwise(x) for a, x in zip(num, p)]
    if method == 1:
        return [F.when(a == 0, (a + EPSILON) / b).otherwise(x) for a, b, x in zip(num, den, p)]
    if method == 2:
        return [(a + 1) / (b + 1) for a, b in zip(num, den)]
    if method == 3:
        out, zeros = [], F.lit(0)
        for a, b, x in zip(num, den, p):
            zeros = zeros + F.when(a == 0, 1).otherwise(0)
            out.append(F.when(a == 0, 1 / (F.pow(F.lit(2.0), zeros) * b)).otherwise(x))
        return out
    if method in (4, 7):
        length = F.col("hyp_len")
        p = [F.when(a != 0, x).when(length > 1, (i + K / F.ln(length)) / b).when(length == 1, none).otherwise(x) for i, (a, b, x) in enumerate(zip(num, den, p))]
    if method in (5, 7):
        after = [*p[1:], F.col(f"num_{orders + 1}") / F.col(f"den_{orders + 1}")]
        out, before = [], p[0] + 1
        for x, y in zip(p, after):
            before = (before + x + y) / 3
            out.append(before)
        return out
    if method == 6:
        out = p[:2]
        for i in range(2, orders):
            prior = F.when(out[i - 2] == 0, 0.0).otherwise(out[i - 1] * out[i - 1] / out[i - 2])
            x = (num[i] + ALPHA * prior) / (F.greatest(F.lit(0), F.col("hyp_len") - i) + ALPHA)
            out.append(F.when(num[2] == 0, none).otherwise(x))
        return out
    if method != 4:
        raise ValueError(method)
    return p


def bleu(method: int = 1, orders: int = ORDERS, reweigh: bool = False) -> Column:
    """Sentence BLEU of a row of matches(); 0 without a matching word."""
    if reweigh:
        n = F.when(F.col("hyp_len") < orders, F.greatest(F.col("hyp_len"), F.lit(1)).cast("double")).otherwise(F.lit(float(orders)))
        logs = [F.when(F.lit(i) < n, F.ln(p) / n).otherwise(0.0) for i, p in enumerate(smoothed(method, orders))]
    else:
        logs = [F.ln(p) / orders for p in smoothed(method, orders)]
    total = logs[0]
    for x in logs[1:]:
        total = total + x
    return F.when(F.col("num_1") == 0, 0.0).otherwise(brevity_penalty(F.col("ref_len"), F.col("hyp_len")) * F.exp(total))


def corpus(matched: DataFrame, orders: int = ORDERS) -> DataFrame:
    """One row of summed numerators, denominators and lengths: the input of corpus BLEU."""
    names = ["hyp_len", "ref_len", *(f"{a}_{n}" for a in ("num", "den") for n in range(1, orders + 1))]
    return matched.agg(*(F.sum(n).alias(n) for n in names))


def weighted_recall(pairs: DataFrame, keywords: list[str], orders: int = ORDERS) -> DataFrame:
    """pair_id, n, num and den: recall of the references' n-grams, summed over them; unigrams weigh 1 for keywords and 0.2 otherwise, longer n-grams 1.

    A reference without n-grams of an order adds 1 to its denominator.
    """
    ship(pairs.sparkSession)
    heavy = frozenset(keywords)
    kind = "array<struct<n:int,num:double,den:double>>"
    arrow = pa.list_(pa.struct([("n", pa.int32()), ("num", pa.float64()), ("den", pa.float64())]))

    def recall(hypothesis, words, n):
        own, other = counted(hypothesis, n), counted(words, n)
        weight = (lambda g: 1.0 if g in heavy else 0.2) if n == 1 else (lambda g: 1.0)
        return sum(min(k, own[g]) * weight(g) for g, k in other.items() if g in own), max(1.0, sum(k * weight(g) for g, k in other.items()))

    @F.arrow_udf(kind)
    def count(hypotheses: pa.Array, others: pa.Array) -> pa.Array:
        rows = []
        for h, rs in _rows(hypotheses, others):
            row = []
            for n in range(1, orders + 1):
                found = [recall(h, r, n) for r in rs]
                row.append({"n": n, "num": sum(f[0] for f in found), "den": sum(f[1] for f in found)})
            rows.append(row)
        return pa.array(rows, arrow)

    own = F.coalesce(tokens(F.col("hypothesis")), F.array().cast("array<string>"))
    other = F.transform(F.filter(references(pairs), lambda r: r.isNotNull()), lambda r: tokens(r))
    return pairs.select("pair_id", F.explode(count(own, other)).alias("r")).select("pair_id", "r.*")
