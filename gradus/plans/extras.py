"""Further queries: prompts of classification, validation, pruning and code similarity."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import classification, maths, strings
from ..operators import generation, mutation, similarity
from ..registry import Entry
from ..session import ship
from . import views as v
from .scores import _round, _scored
from .texts import _MATCHES, _grams_sql, _matched, reweighed_sql

def _accuracy(s, d):
    return _scored(s, d).groupBy("prompt").agg(F.round(F.avg((F.col("gap") > 0).cast("double")), 6).alias("accuracy"))


_ACC = f"WITH {v.LOGITS}, acc AS (SELECT prompt, round(avg(CAST(gap > 0 AS DOUBLE)), 6) AS accuracy FROM gaps GROUP BY prompt)"


def _validated_prompt(s, d):
    """The prompt that does best on the validation split, and its accuracy on the test split as it is and with logits standardised by the validation split's moments."""
    scored = _scored(s, d)
    valid, test = scored.where(F.col("example") % 3 == 1), scored.where(F.col("example") % 3 == 2)
    right = F.avg((F.col("gap") > 0).cast("double"))
    best = valid.groupBy("prompt").agg(F.round(right, 9).alias("a")).agg(F.max_by("prompt", F.struct("a", "prompt")).alias("best"))
    moments = valid.select(F.posexplode("logits").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).agg(F.array_sort(F.collect_list(F.struct("k", "m", "v"))).alias("s"))
    # One row each: ten moments and a prompt.
    own = test.crossJoin(F.broadcast(best)).where("prompt = best").crossJoin(F.broadcast(moments))
    calibrated = maths.label_gap(maths.standardised(F.col("logits"), F.col("s.m"), F.col("s.v")), F.col("label"))
    return _round(own.groupBy("best").agg(right.alias("accuracy"), F.avg((calibrated > 0).cast("double")).alias("calibrated")))


_VALIDATED = f"""WITH {v.LOGITS}, acc AS (SELECT prompt, round(avg(CAST(gap > 0 AS DOUBLE)), 9) AS a FROM gaps WHERE example % 3 = 1 GROUP BY prompt), best AS (SELECT arg_max(prompt, struct_pack(a := a, b := prompt)) AS best FROM acc),
x AS (SELECT example, unnest(range(10)) AS k, unnest(logits) AS x FROM logits WHERE example % 3 = 1), m AS (SELECT list(a ORDER BY k) AS m, list(b ORDER BY k) AS v FROM (SELECT k, avg(x) AS a, var_samp(x) AS b FROM x GROUP BY k)),
t AS (SELECT gaps.label, gap, best, list_transform(range(1, 11), lambda i: (logits[i] - m[i]) / sqrt(v[i])) AS z FROM gaps, best, m WHERE example % 3 = 2 AND prompt = best),
c AS (SELECT *, z[label + 1] - list_max(list_transform(z, lambda y: CASE WHEN y = z[label + 1] THEN -1.0 ELSE y END)) AS cal FROM t)
SELECT best, round(avg(CAST(gap > 0 AS DOUBLE)), 6) AS accuracy, round(avg(CAST(cal > 0 AS DOUBLE)), 6) AS calibrated FROM c GROUP BY best"""


def entries() -> dict[str, Entry]:
    e: dict[str, Entry] = {}
    e["f22_sentences"] = Entry(
        lambda s, d: v.table(s, d, "benchmark").select("item_id", F.size(strings.tokens(F.col("text"))).cast("bigint").alias("words"), F.size(F.filter(F.split("text", "[.!?]"), lambda x: F.trim(x) != "")).cast("bigint").alias("sentences"), F.ceil(F.size(strings.tokens(F.col("text"))) / 5).cast("bigint").alias("spans")),
        r"SELECT item_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_filter(string_split_regex(text, '[.!?]'), lambda x: trim(x) <> '')) AS BIGINT) AS sentences, CAST(ceil(len(w) / 5.0) AS BIGINT) AS spans FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)",
    )
    spaced = r"([.,;:!?()\[\]%])"
    undone = r"' ' || array_to_string(list_filter(string_split_regex(regexp_replace(replace(text, 'the ', 'they ''re can not -- '), '([.,;:!?()\[\]%])', ' \1 ', 'g'), '\s+'), lambda x: x <> ''), ' ') || ' '"
    for pattern, kept in classification.TREEBANK:
        undone = "regexp_replace({}, '{}', '{}', 'g')".format(undone, pattern.replace("'", "''"), kept.replace("'", "''"))
    e["f23_detokenised"] = Entry(
        lambda s, d: v.table(s, d, "benchmark").select("item_id", F.md5(classification.detokenised(strings.tokens(F.regexp_replace(F.replace("text", F.lit("the "), F.lit("they 're can not -- ")), spaced, " $1 ")))).alias("h")),
        f"SELECT item_id, md5(trim({undone})) AS h FROM benchmark",
    )
    e["b05_reweighed"] = Entry(lambda s, d: _round(_matched(s, d).select("pair_id", similarity.bleu(1, reweigh=True).alias("bleu"))), f"{_MATCHES} SELECT pair_id, round({reweighed_sql()}, 6) AS bleu FROM matched")
    recall = f"{v.PAIRS}, {_grams_sql('h')}, {_grams_sql('r')}, w AS (SELECT r.pair_id, r.n, r.k, coalesce(h.k, 0) AS hk, CASE WHEN r.n > 1 OR gram IN ('the','of') THEN 1.0 ELSE 0.2 END AS w FROM rg r LEFT JOIN hg h USING (pair_id, n, gram)), p AS (SELECT e.pair_id, e.n, coalesce(sum(least(k, hk) * w), 0) AS num, greatest(1.0, coalesce(sum(k * w), 0)) AS den FROM (SELECT pair_id, unnest(range(1, 5)) AS n FROM pairs) e LEFT JOIN w ON w.pair_id = e.pair_id AND w.n = e.n GROUP BY ALL), c AS (SELECT n, sum(num) AS num, sum(den) AS den FROM p GROUP BY n)"
    e["b07_weighted_corpus"] = Entry(
        lambda s, d: _round(similarity.weighted_recall(v.pairs(s, d), ["the", "of"]).groupBy("n").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).agg(F.exp(F.avg(F.ln(F.col("num") / F.col("den")))).alias("score")), 5),
        f"WITH {recall} SELECT round(exp(avg(ln(num / den))), 5) AS score FROM c",
    )
    e["e03_best_tokens"] = Entry(lambda s, d: _scored(s, d).select("example", F.posexplode("p").alias("k", "p")).groupBy("example").agg(F.max_by("k", F.struct("p", -F.col("k"))).cast("bigint").alias("token")), f"WITH {v.LOGITS}, x AS (SELECT example, unnest(range(10)) AS k, unnest(p) AS p FROM soft) SELECT example, arg_max(k, struct_pack(a := p, b := -k)) AS token FROM x GROUP BY example")
    e["i09_pruned_vocabulary"] = Entry(
        lambda s, d: (lambda t: t.crossJoin(F.broadcast(t.agg(F.percentile("kl", 0.5).alias("least")))).where("kl > least").select("label"))(_scored(s, d).groupBy("label").agg(F.round(F.sum(maths.kl(F.col("p"), F.col("q"))), 9).alias("kl"))),
        f"WITH {v.LOGITS}, t AS (SELECT label, round(sum(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2])))), 9) AS kl FROM soft GROUP BY label) SELECT label FROM t WHERE kl > (SELECT quantile_cont(kl, 0.5) FROM t)",
    )
    e["i10_validated_prompt"] = Entry(_validated_prompt, _VALIDATED)
    e["i11_seed_table"] = Entry(
        lambda s, d: _round(_scored(s, d).withColumn("seed", F.col("example") % 3).groupBy("prompt").pivot("seed", [0, 1, 2]).agg(F.avg((F.col("gap") > 0).cast("double"))).toDF("prompt", "seed_0", "seed_1", "seed_2")),
        f"WITH {v.LOGITS} SELECT prompt, {', '.join(f'round(avg(CAST(gap > 0 AS DOUBLE)) FILTER (WHERE example % 3 = {k}), 6) AS seed_{k}' for k in range(3))} FROM gaps GROUP BY prompt",
    )
    said = "'{\"choices\": [{\"text\": \"' || event_type || '\", \"logprobs\": {\"tokens\": [\"' || event_type || '\", \".\"], \"token_logprobs\": [-' || CAST(event_id % 7 AS VARCHAR) || '.5, -1]}}]}'"
    e["e03_text_logprobs"] = Entry(
        lambda s, d: generation.text_and_logprobs(v.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("no answer")).otherwise(F.expr(said.replace("VARCHAR", "STRING"))).alias("response"))).select("event_id", "text", F.array_join("tokens", "|").alias("tokens"), F.aggregate("logprobs", F.lit(0.0), lambda a, x: a + x).alias("total")),
        "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS text, CASE WHEN event_id % 11 <> 0 THEN event_type || '|.' END AS tokens, CASE WHEN event_id % 11 <> 0 THEN -(event_id % 7) - 1.5 END AS total FROM events",
    )
    return e
