"""CodeBLEU over a corpus: n-grams, weighted n-grams, syntax and data flow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import flow
from ..functions.maths import brevity_penalty
from ..session import ship
from ..sources.files import KEYWORDS
from . import similarity

WEIGHTS = (0.25, 0.25, 0.25, 0.25)


def structure(pairs: DataFrame, language: str) -> DataFrame:
    """pair_id with hits and totals of syntax (syntax_hits, syntax_total) and of data flow (flow_hits, flow_total)."""
    ship(pairs.sparkSession)
    names = ["syntax_hits", "syntax_total", "flow_hits", "flow_total"]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def count(hypotheses: pa.Array, references: pa.Array) -> pa.Array:
        syntax, data = flow.counters()
        rows = [(*syntax(h or "", [r for r in rs if r is not None], language), *data(h or "", [r for r in rs if r is not None], language)) for h, rs in similarity._rows(hypotheses, references)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=names)

    return pairs.select("pair_id", count(F.col("hypothesis"), similarity.references(pairs)).alias("s")).select("pair_id", "s.*")


def code_bleu(pairs: DataFrame, language: str, weights: tuple[float, float, float, float] = WEIGHTS, keywords: list[str] | None = None) -> DataFrame:
    """One row: ngram, weighted, syntax, flow and code_bleu of all pairs.

    Every part is a quotient of sums over the corpus; a part without anything to match is 0.
    """
    heavy = KEYWORDS.get(flow.LANGUAGES[language], []) if keywords is None else keywords
    matched = similarity.matches(pairs)
    total = similarity.corpus(matched)
    ngram = total.select(similarity.bleu(1).alias("ngram"), brevity_penalty(F.col("ref_len"), F.col("hyp_len")).alias("bp"))
    recall = similarity.weighted_recall(pairs, heavy).groupBy("n").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    logs = F.avg(F.ln(F.when(F.col("num") == 0, F.lit(similarity.EPSILON)).otherwise(F.col("num")) / F.col("den")))
    recall = recall.agg(F.exp(logs).alias("mean"), F.max(F.when(F.col("n") == 1, F.col("num"))).alias("first"))
    built = structure(pairs, language).agg(*(F.coalesce(F.sum(f"{k}_hits") / F.nullif(F.sum(f"{k}_total"), F.lit(0)), F.lit(0.0)).alias(k) for k in ("syntax", "flow")))
    # One row each.
    out = ngram.crossJoin(F.broadcast(recall)).crossJoin(F.broadcast(built))
    out = out.select("ngram", F.when(F.col("first") == 0, 0.0).otherwise(F.col("bp") * F.col("mean")).alias("weighted"), "syntax", "flow")
    return out.withColumn("code_bleu", sum((F.lit(w) * F.col(c) for w, c in zip(weights, out.columns)), F.lit(0.0)))
