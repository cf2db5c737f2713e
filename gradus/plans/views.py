"""Views that bind the star-schema tables to the workload's data model.

Each view is a DataFrame and, for the checks, the same as a SQL CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per executed sample: task_id, sample_id, passed."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("sample_id"), (F.col("event_type") != "error").alias("passed"))


RUNS = "runs AS (SELECT user_id AS task_id, event_id AS sample_id, event_type <> 'error' AS passed FROM events)"


def runs_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few samples a task and repeated keys; ord orders the repetitions."""
    l = table(spark, sf_dir, "lineitem")
    order = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linestatus"), F.col("l_returnflag"), F.col("l_quantity").cast("bigint").cast("string"), F.floor(F.col("l_extendedprice") * 100).cast("string"))
    return l.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("sample_id"), (F.col("l_returnflag") == "R").alias("passed"), F.md5(order).alias("ord"))


RUNS_SMALL = """runs_small AS (SELECT l_orderkey AS task_id, l_linenumber AS sample_id, l_returnflag = 'R' AS passed,
  md5(concat_ws('|', l_partkey, l_suppkey, l_linestatus, l_returnflag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(floor(l_extendedprice * 100) AS BIGINT))) AS ord FROM lineitem)"""


def leaderboard_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hyper, model, data, task_id, passed from orders and their lines."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_orderstatus").alias("hyper"), F.col("o_orderpriority").alias("model"), F.col("l_linestatus").alias("data"), F.col("o_orderkey").alias("task_id"), (F.col("l_returnflag") == "R").alias("passed"))


BOARD = """board AS (SELECT o_orderstatus AS hyper, o_orderpriority AS model, l_linestatus AS data, o_orderkey AS task_id, l_returnflag = 'R' AS passed
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothesis and reference: a document and the next with the same language and beginning."""
    w = Window.partitionBy("lang", F.substring("text", 1, 30)).orderBy("doc_id")
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("hypothesis"), F.lead("text").over(w).alias("reference")).where("reference IS NOT NULL")


PAIRS = """pairs AS (SELECT * FROM (SELECT doc_id AS pair_id, text AS hypothesis, lead(text) OVER (PARTITION BY lang, substring(text, 1, 30) ORDER BY doc_id) AS reference FROM documents) WHERE reference IS NOT NULL)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example, label, logits (10 classes) and a prompt that the example is scored under."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("example"), F.col("label").cast("int").alias("label"), F.slice(v, 1, 10).alias("logits"), F.slice(v, 11, 10).alias("default_logits"), (F.col("vec_id") % 7).alias("prompt"))


LOGITS = """logits AS (SELECT vec_id AS example, label, CAST(embedding[1:10] AS DOUBLE[]) AS logits, CAST(embedding[11:20] AS DOUBLE[]) AS default_logits, vec_id % 7 AS prompt FROM embeddings),
probs AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e, list_transform(default_logits, lambda x: exp(x - list_max(default_logits))) AS de FROM logits),
soft AS (SELECT example, label, prompt, logits, default_logits, list_transform(e, lambda x: x / list_sum(e)) AS p, list_transform(de, lambda x: x / list_sum(de)) AS q FROM probs),
gaps AS (SELECT *, p[label + 1] AS own, p[label + 1] - list_max(list_transform(p, lambda x: CASE WHEN x = p[label + 1] THEN -1.0 ELSE x END)) AS gap FROM soft)"""


def fewshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return l.join(d, "doc_id").select(F.col("quality").alias("label"), "doc_id", "text")


FEWSHOT = "fewshot AS (SELECT l.quality AS label, l.doc_id, d.text FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, score (its count) and id (its rank)."""
    d = table(spark, sf_dir, "documents")
    t = d.select(F.explode(F.split("text", "[ \n]")).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("score"))
    # Token ids by bytes: the rank over a vocabulary, which is bounded by its size, not the corpus'.
    return t.withColumn("id", F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint"), F.lit(1 << 31)))


VOCAB = """vocab AS (SELECT token, count(*) AS score, CAST('0x' || substring(md5(token), 1, 8) AS BIGINT) % 2147483648 AS id FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS token FROM documents) WHERE token <> '' GROUP BY token)"""
