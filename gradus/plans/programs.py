"""Queries on source code, sources, generation and search."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from ..functions import code, strings
from ..operators import generation, search
from ..registry import Entry
from ..session import shared_dir, ship
from ..sources import files
from ..streaming import passes
from . import views as v

def _gold(rows: list[tuple], *names: str) -> str:
    def show(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, float) else f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({', '.join(names)})"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gradus-files-{uuid.uuid4().hex}"


def _round_trip(write, read):
    def run(s, d):
        path = _scratch(s)
        write(s, d, path)
        return read(s, path)

    return run


def _searched(find):
    """Search for a prompt of words that score by how many documents hold them."""

    def run(s, d):
        docs = v.table(s, d, "benchmark").select("text")
        scorer = search.frame_scorer(s, docs, F.size(F.array_intersect(F.split("text", " "), F.split("prompt", " "))).cast("double"))
        text, score = find(scorer)
        return s.createDataFrame([(text, round(float(score), 6))], "prompt string, score double")

    return run


_WORDS = ["the", "of", "and", "to", "in", "er", "th", "re"]


def entries() -> dict[str, Entry]:
    e: dict[str, Entry] = {}
    e["e01_completed"] = Entry(lambda s, d: (ship(s), generation.completed(v.table(s, d, "benchmark").select("item_id", F.col("text").alias("prompt")), generation.StubCompleter("{digest}"), wait=0))[1].select("item_id", "answer"), "SELECT item_id, substring(md5(text), 1, 8) AS answer FROM benchmark")
    e["s03_lookup"] = Entry(lambda s, d: files.lookup(v.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), v.table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey"), "SELECT n_nationkey, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
    e["s01_scan"] = Entry(lambda s, d: v.table(s, d, "nation"), "SELECT * FROM nation")
    e["s04_json"] = Entry(_round_trip(lambda s, d, p: files.write_json(v.table(s, d, "region"), p), lambda s, p: files.json_rows(s, p, "r_regionkey int, r_name string", whole=False)), "SELECT r_regionkey, r_name FROM region")
    e["s06_board"] = Entry(_round_trip(lambda s, d, p: files.write_board(v.leaderboard_runs(s, d).groupBy("hyper", "model").agg(F.count(F.lit(1)).alias("n")), p), lambda s, p: s.read.option("header", True).csv(p).select("model", F.col("n").cast("bigint").alias("n"), F.col("hyper").cast("string").alias("hyper"))), f"WITH {v.BOARD} SELECT model, count(*) AS n, hyper FROM board GROUP BY ALL")
    e["s07_few_shot_rows"] = Entry(_round_trip(lambda s, d, p: v.fewshot(s, d).select(F.md5("text").alias("sentence"), "label").write.csv(p, sep="\t", header=True), lambda s, p: files.few_shot_rows(s, p)), f"WITH {v.FEWSHOT} SELECT md5(text) AS text, label FROM fewshot")
    e["s08_s15_write_once"] = Entry(_round_trip(lambda s, d, p: [files.write_once(v.table(s, d, t), p) for t in ("region", "nation")], lambda s, p: s.read.parquet(p)), "SELECT * FROM region")
    e["s13_published"] = Entry(_round_trip(lambda s, d, p: files.publish(v.table(s, d, "supplier").withColumn("split", F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd")), p), lambda s, p: s.read.parquet(p).groupBy("split").agg(F.count(F.lit(1)).alias("n"))), "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS split, count(*) AS n FROM supplier GROUP BY ALL")
    e["s16_latest"] = Entry(lambda s, d: files.latest(v.table(s, d, "orders").select(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name"))), "SELECT max('checkpoint-' || o_orderkey) AS latest FROM orders")
    for name, first in (("s17_first_variant", True), ("s18_all_variants", False)):
        e[name] = Entry(lambda s, d, first=first: files.variants(v.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("p"), F.split("p_type", " ").alias("x")), "p", "x", first).select("data_id", "variant"), "SELECT p || '____SPLIT____' || i AS data_id, x[i + 1] AS variant FROM (SELECT CAST(p_partkey AS VARCHAR) AS p, string_split(p_type, ' ') AS x, unnest(range(len(string_split(p_type, ' ')))) AS i FROM part)" + (" WHERE i = 0" if first else ""))
    e["i01_scored_prompts"] = Entry(_searched(lambda f: ("the of", f(["the of"])[0])), "SELECT 'the of' AS prompt, round(avg(CAST(list_contains(w, 'the') AS INT) + CAST(list_contains(w, 'of') AS INT)), 6) AS score FROM (SELECT string_split(text, ' ') AS w FROM benchmark)")
    e["i02_edit_search"] = Entry(_searched(lambda f: (lambda r: (r[0], r[1][-1]))(search.edit_search("the of and xx yy", f, 3))))
    e["i03_model_search"] = Entry(_searched(lambda f: (lambda r: (r[0], r[1][-1]))(search.model_search(["the", "of"], f, lambda asked: ["the of and"], 2))))
    e["i04_first_demos"] = Entry(lambda s, d: v.fewshot(s, d).orderBy("doc_id").limit(3).select("doc_id", "label"), f"WITH {v.FEWSHOT} SELECT doc_id, label FROM fewshot ORDER BY doc_id LIMIT 3")
    # A word adds the share of the texts that hold it, whatever stands before it: the greedy prompt is the five commonest.
    listed = ", ".join(f"({i}, '{w}')" for i, w in enumerate(_WORDS))
    e["i05_greedy"] = Entry(
        _searched(lambda f: search.greedy(_WORDS, f)),
        f"WITH t AS (SELECT string_split(text, ' ') AS w FROM benchmark), s AS (SELECT i, v, avg(CAST(list_contains(t.w, v) AS INT)) AS share FROM t, (VALUES {listed}) l(i, v) GROUP BY i, v), top AS (SELECT * FROM s ORDER BY share DESC, i LIMIT 5) SELECT string_agg(v, ' ' ORDER BY share DESC, i) AS prompt, round(sum(share), 6) AS score FROM top",
    )
    e["i06_genetic"] = Entry(_searched(lambda f: (lambda r: (r[0], r[1][-1]))(search.genetic(_WORDS, f))))
    e["i07_random"] = Entry(_searched(lambda f: search.random_search(_WORDS, f)))
    e["i08_swarm"] = Entry(_searched(lambda f: (lambda r: (r[0], r[1][-1]))(search.swarm(_WORDS, f))))
    e["s03_models"] = Entry(_models, "SELECT n_nationkey, 'provider' || n_regionkey AS provider, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'chat' ELSE 'completion' END AS kind FROM nation")
    e["x01_pass_stream"] = Entry(_streamed, "SELECT user_id AS task_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS c FROM events GROUP BY user_id")
    return e


def _models(s, d):
    """The model registry that a caller lists, looked up by tasks that name their model."""
    listed = [(r["n_nationkey"], f"provider{r['n_regionkey']}", r["n_name"], "chat" if r["n_nationkey"] % 2 == 0 else "completion", 1) for r in v.table(s, d, "nation").collect()]
    return files.lookup(v.table(s, d, "nation").select("n_nationkey", F.col("n_nationkey").alias("model_id")), files.models(s, listed), "model_id").select("n_nationkey", "provider", "name", "kind")


def _gold_int(rows) -> str:
    return f"SELECT * FROM (VALUES {', '.join(repr(tuple(r)) for r in rows)}) t(data_id, source, split, name)"


def _streamed(spark: SparkSession, sf_dir: str):
    """The stream of runs, read to its end into a table of changes; the newest row of each task."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    single = spark.read.format("binaryFile").load(path).count() == 1
    events = spark.readStream.schema(schema).option("pathGlobFilter", name if single else "*").parquet(folder if single else path)
    runs = events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("sample_id"), (F.col("event_type") != "error").alias("passed"))
    table = _scratch(spark)
    passes.start(runs, table, _scratch(spark)).awaitTermination()
    return passes.latest(spark, table).select("task_id", "n", "c")
