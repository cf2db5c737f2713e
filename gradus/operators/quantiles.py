"""Exact percentiles without holding a group's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Relative accuracy of the sketch that brackets a percentile.
ACCURACY = 10_000


def percentiles(rows: DataFrame, value: str, shares: list[float], by: list[str], accuracy: int = ACCURACY) -> DataFrame:
    """``by`` and p0, p1, ...: exact percentiles of ``shares``, interpolated between neighbours; nulls do not count.

    A mergeable sketch brackets each percentile between two values (a group of few rows, whose ranks the sketch may miss by
    more than its slack, lies within its bracket whole); what lies below is only counted, and
    the few distinct values within the bracket are ranked with their counts.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    slack = 2.0 / accuracy
    ends = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-slack, slack)]
    sketch = rows.groupBy(*by).agg(F.count("__x").alias("__n"), F.percentile_approx("__x", ends, accuracy).alias("__e"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    each = F.array(*(F.struct(F.lit(k).alias("k"), (F.when(F.lit(p <= slack) | (F.col("__n") <= 10 * accuracy), F.col("__min")).otherwise(F.col("__e")[2 * k])).alias("low"), (F.when(F.lit(p >= 1 - slack) | (F.col("__n") <= 10 * accuracy), F.col("__max")).otherwise(F.col("__e")[2 * k + 1])).alias("high"), F.lit(float(p)).alias("p")) for k, p in enumerate(shares)))
    brackets = sketch.select(*by, "__n", F.explode(each).alias("b")).select(*by, "__n", "b.*")
    low, high = ([F.max(F.when(F.col("k") == k, F.col(c))) for k in range(len(shares))] for c in ("low", "high"))
    wide = brackets.groupBy(*by).agg(F.first("__n").alias("__n"), *(x.alias(f"__l{k}") for k, x in enumerate(low)), *(x.alias(f"__h{k}") for k, x in enumerate(high)))
    met = rows.join(wide, by) if by else rows.crossJoin(F.broadcast(wide))
    below = met.groupBy(*by).agg(F.first("__n").alias("__n"), *(F.count_if(F.col("__x") < F.col(f"__l{k}")).alias(f"__b{k}") for k in range(len(shares))))
    inside = F.filter(F.array(*(F.when((F.col("__x") >= F.col(f"__l{k}")) & (F.col("__x") <= F.col(f"__h{k}")), F.lit(k)) for k in range(len(shares)))), lambda k: k.isNotNull())
    values = met.select(*by, "__x", F.explode(inside).alias("k")).groupBy(*by, "k", "__x").agg(F.count(F.lit(1)).alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(*by, "k").orderBy("__x"))
    values = values.withColumn("__to", up_to)
    base = F.element_at(F.array(*(F.col(f"__b{k}") for k in range(len(shares)))), F.col("k") + 1)
    share = F.element_at(F.array(*(F.lit(float(p)) for p in shares)), F.col("k") + 1)
    placed = (values.join(below, by) if by else values.crossJoin(F.broadcast(below))).withColumn("__at", share * (F.col("__n") - 1)).withColumn("__last", base + F.col("__to"))
    # The value at rank r (from 0) is the first whose cumulated count exceeds r.
    first = F.min(F.when(F.col("__last") > F.floor("__at"), F.col("__x")))
    second = F.min(F.when(F.col("__last") > F.ceil("__at"), F.col("__x")))
    got = placed.groupBy(*by, "k").agg(first.alias("a"), second.alias("z"), F.first("__at").alias("__at"))
    part = F.col("__at") - F.floor("__at")
    got = got.select(*by, "k", (F.col("a") + (F.coalesce("z", "a") - F.col("a")) * part).alias("v"))
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"p{k}") for k in range(len(shares))))
