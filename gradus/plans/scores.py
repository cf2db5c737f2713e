"""Queries on runs, leaderboards, sampling and logits, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import maths, strings
from ..operators import metrics, quantiles, sampling
from ..registry import Entry
from . import views as v

_PASS = {k: f"CASE WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k} / CAST(i AS DOUBLE))) END" for k in metrics.KS}


def _passes(source: str, by: str) -> str:
    return f"passes AS (SELECT *, {', '.join(f'{e} AS pass_{k}' for k, e in _PASS.items())} FROM (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM {source} GROUP BY ALL))"


def _round(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_ROUNDED = ", ".join(f"round(pass_{k}, 6) AS pass_{k}" for k in metrics.KS)
_MEANS = ", ".join(f"round(avg(pass_{k}), 6) AS pass_{k}" for k in metrics.KS)
_DEDUPED = "deduped AS (SELECT task_id, sample_id, arg_max(passed, ord) AS passed FROM runs_small GROUP BY ALL)"


def _named(spark, sf):
    """pass@k per variant, under names that join seed and variant."""
    l = v.table(spark, sf, "lineitem")
    name = F.concat(F.lit("seed"), (F.col("l_orderkey") % 50).cast("string"), F.lit(strings.ID_SEPARATOR), (F.col("l_orderkey") % 7).cast("string"))
    rows = l.select(F.col("l_linestatus").alias("data"), name.alias("name"), (F.col("l_returnflag") == "R").alias("passed"))
    return metrics.pass_table(rows, ["data", "name"])


_NAMED = "named AS (SELECT l_linestatus AS data, 'seed' || (l_orderkey % 50) || '____SPLIT____' || (l_orderkey % 7) AS name, l_returnflag = 'R' AS passed FROM lineitem)"


def _board(spark, sf):
    per_task = metrics.pass_table(v.leaderboard_runs(spark, sf), ["hyper", "model", "data", "task_id"])
    return metrics.macro_mean(per_task, ["hyper", "model", "data"])


_BOARD = f"WITH {v.BOARD}, {_passes('board', 'hyper, model, data, task_id')}, means AS (SELECT hyper, model, data, {', '.join(f'avg(pass_{k}) AS pass_{k}' for k in metrics.KS)} FROM passes GROUP BY ALL)"


def _cells(sql: bool):
    return ", ".join(f"round(max(pass_{k}) FILTER (WHERE data = '{d}'), 6) AS \"{d}_pass_{k}\"" for d in ("F", "O") for k in metrics.KS)


def _scored(spark, sf):
    l = v.logits(spark, sf)
    p = l.withColumn("p", maths.softmax(F.col("logits"))).withColumn("q", maths.softmax(F.col("default_logits")))
    return p.withColumn("gap", maths.label_gap(F.col("p"), F.col("label")))


def _md5(*parts):
    return F.md5(F.concat_ws("|", *parts))


def entries() -> dict[str, Entry]:
    e: dict[str, Entry] = {}
    e["flagship_pass_at_k"] = Entry(
        lambda s, d: _round(metrics.macro_mean(metrics.pass_table(metrics.last_runs(v.runs_small(s, d), "ord"), ["task_id"]), [])),
        f"WITH {v.RUNS_SMALL}, {_DEDUPED}, {_passes('deduped', 'task_id')} SELECT {_MEANS}, count(*) AS tasks FROM passes",
    )
    e["a01_pass_at_k"] = Entry(lambda s, d: _round(metrics.pass_table(v.runs(s, d), ["task_id"])), f"WITH {v.RUNS}, {_passes('runs', 'task_id')} SELECT task_id, n, c, {_ROUNDED} FROM passes")
    e["a01_pass_at_k_strict"] = Entry(
        lambda s, d: _round(metrics.pass_table(metrics.last_runs(v.runs_small(s, d), "ord"), ["task_id"], strict=True)),
        f"WITH {v.RUNS_SMALL}, {_DEDUPED}, {_passes('deduped', 'task_id')} SELECT task_id, n, c, {', '.join(f'CASE WHEN n >= {k} THEN round(pass_{k}, 6) END AS pass_{k}' for k in metrics.KS)} FROM passes",
    )
    e["a02_last_run"] = Entry(lambda s, d: metrics.last_runs(v.runs_small(s, d), "ord"), f"WITH {v.RUNS_SMALL}, {_DEDUPED} SELECT * FROM deduped")
    e["a03_macro_mean"] = Entry(lambda s, d: _round(metrics.macro_mean(metrics.pass_table(v.runs(s, d), ["task_id"]), [])), f"WITH {v.RUNS}, {_passes('runs', 'task_id')} SELECT {_MEANS}, count(*) AS tasks FROM passes")
    e["a04_two_level_mean"] = Entry(
        lambda s, d: _round(metrics.two_level_mean(_named(s, d), "name", ["data"])),
        f"WITH {_NAMED}, {_passes('named', 'data, name')}, inner_ AS (SELECT data, split_part(name, '____SPLIT____', 1) AS seed, {', '.join(f'avg({f}) AS {f}' for f in [*(f'pass_{k}' for k in metrics.KS), 'n'])} FROM passes GROUP BY ALL) SELECT data, {', '.join(f'round(avg({f}), 6) AS {f}' for f in [*(f'pass_{k}' for k in metrics.KS), 'n'])} FROM inner_ GROUP BY ALL",
    )
    e["a05_leaderboard"] = Entry(lambda s, d: _round(metrics.leaderboard(_board(s, d), ["F", "O"])), f"{_BOARD} SELECT hyper, model, {_cells(True)} FROM means GROUP BY ALL")
    e["a06_group_list"] = Entry(
        lambda s, d: v.table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles")),
        "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    )
    e["a07_names"] = Entry(lambda s, d: v.leaderboard_runs(s, d).groupBy("hyper").agg(F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models")), f"WITH {v.BOARD} SELECT hyper, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM board GROUP BY hyper")
    e["a08_first_wins"] = Entry(lambda s, d: v.table(s, d, "conversations").groupBy("role", "turn").agg(F.min_by("text", "conv_id").alias("text")), "SELECT role, turn, arg_min(text, conv_id) AS text FROM conversations GROUP BY ALL")
    e["a09_general_types"] = Entry(
        lambda s, d: v.table(s, d, "events").select("user_id", F.filter(F.array(F.get_json_object("props", "$.k"), F.when(F.col("event_type") != "view", F.col("event_type"))), lambda x: x.isNotNull()).alias("t")).withColumn("most", F.max(F.size("t")).over(Window.partitionBy("user_id"))).where(F.size("t") == F.col("most")).select("user_id", F.posexplode("t").alias("place", "kind")).where("place > 0").groupBy("user_id", "place").agg(F.sort_array(F.collect_set("kind")).alias("k")).select("user_id", F.col("place").cast("bigint").alias("place"), F.when(F.size("k") == 1, F.col("k")[0]).otherwise(F.concat(F.lit("mixed("), F.array_join("k", ", "), F.lit(")"))).alias("kind")),
        "WITH t AS (SELECT user_id, event_type AS kind, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS size FROM events), m AS (SELECT *, max(size) OVER (PARTITION BY user_id) AS most FROM t) SELECT user_id, CAST(1 AS BIGINT) AS place, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed(' || string_agg(DISTINCT kind, ', ' ORDER BY kind) || ')' END AS kind FROM m WHERE size = most AND size > 1 GROUP BY user_id",
    )
    e["a10_mean_score"] = Entry(lambda s, d: _round(v.runs(s, d).agg(F.avg(F.col("passed").cast("double")).alias("score"))), f"WITH {v.RUNS} SELECT round(avg(CAST(passed AS DOUBLE)), 6) AS score FROM runs")
    e["a12_prompt_statistics"] = Entry(
        lambda s, d: _round(_scored(s, d).groupBy("prompt").agg(F.avg((F.col("gap") > 0).cast("double")).alias("accuracy"), F.avg(F.array_max("p")).alias("confidence"), F.sum(maths.entropy(F.col("p"))).alias("entropy"), F.avg(maths.gap_reward(F.col("gap"))).alias("gap_reward"), F.avg(maths.cross_entropy_of_probabilities(F.col("p"), F.col("label"))).alias("ce_reward")), 5),
        f"WITH {v.LOGITS} SELECT prompt, round(avg(CAST(gap > 0 AS DOUBLE)), 5) AS accuracy, round(avg(list_max(p)), 5) AS confidence, round(sum(-list_sum(list_transform(p, lambda x: x * ln(x)))), 5) AS entropy, round(avg(gap * CASE WHEN gap > 0 THEN 200 ELSE 180 END), 5) AS gap_reward, round(avg(own - ln(list_sum(list_transform(p, lambda x: exp(x))))), 5) AS ce_reward FROM gaps GROUP BY prompt",
    )
    e["a13_correct_by_class"] = Entry(lambda s, d: _scored(s, d).where("gap > 0").groupBy("label").agg(F.count(F.lit(1)).alias("right")), f"WITH {v.LOGITS} SELECT label, count(*) AS right FROM gaps WHERE gap > 0 GROUP BY label")
    e["a14_calibration_error"] = Entry(
        lambda s, d: _round(_scored(s, d).groupBy("prompt").agg(F.avg((F.col("gap") > 0).cast("double")).alias("a"), F.avg(F.array_max("p")).alias("c")).agg(F.avg(F.abs(F.col("a") - F.col("c"))).alias("ece"))),
        f"WITH {v.LOGITS}, per AS (SELECT prompt, avg(CAST(gap > 0 AS DOUBLE)) AS a, avg(list_max(p)) AS c FROM gaps GROUP BY prompt) SELECT round(avg(abs(a - c)), 6) AS ece FROM per",
    )
    e["a15_weighted_accuracy"] = Entry(
        lambda s, d: _round(_scored(s, d).groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gap") > 0).cast("double")).alias("a")).agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("accuracy"))),
        f"WITH {v.LOGITS}, per AS (SELECT prompt, count(*) AS n, avg(CAST(gap > 0 AS DOUBLE)) AS a FROM gaps GROUP BY prompt) SELECT round(sum(a * n) / sum(n), 6) AS accuracy FROM per",
    )
    e["a16_weighted_mean"] = Entry(lambda s, d: _round(v.table(s, d, "lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("mean"), F.count(F.lit(1)).alias("n"))), "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_returnflag")
    e["a17_percentile"] = Entry(lambda s, d: _round(quantiles.percentiles(v.table(s, d, "events"), "value", [0.5, 0.9, 0.99], ["event_type"]).toDF("event_type", "p50", "p90", "p99")), "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
    e["a18_dimension_moments"] = Entry(
        lambda s, d: _round(v.logits(s, d).select(F.posexplode("logits").alias("k", "x")).groupBy(F.col("k").cast("bigint").alias("k")).agg(F.avg("x").alias("mean"), F.median("x").alias("median"), F.var_samp("x").alias("variance"))),
        f"WITH {v.LOGITS}, x AS (SELECT unnest(range(10)) AS k, unnest(logits) AS x FROM logits) SELECT k, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(var_samp(x), 6) AS variance FROM x GROUP BY k",
    )
    e["a19_z_scores"] = Entry(
        lambda s, d: _round(_scored(s, d).groupBy("prompt").agg(F.avg("gap").alias("r")).agg(F.collect_list(F.struct("prompt", "r")).alias("all"), F.avg("r").alias("m"), F.stddev_pop("r").alias("sd")).select(F.explode("all").alias("x"), "m", "sd").select("x.prompt", ((F.col("x.r") - F.col("m")) / (F.col("sd") + 1e-4)).alias("z")), 4),
        f"WITH {v.LOGITS}, per AS (SELECT prompt, avg(gap) AS r FROM gaps GROUP BY prompt) SELECT prompt, round((r - avg(r) OVER ()) / (stddev_pop(r) OVER () + 1e-4), 4) AS z FROM per",
    )
    e["a20_kl_by_prompt"] = Entry(lambda s, d: _round(_scored(s, d).groupBy("prompt").agg(F.sum(maths.kl(F.col("p"), F.col("q"))).alias("kl"))), f"WITH {v.LOGITS} SELECT prompt, round(sum(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2])))), 6) AS kl FROM soft GROUP BY prompt")
    e["a21_reward_difference"] = Entry(
        lambda s, d: _round(_scored(s, d).groupBy("prompt").agg(F.sum(F.col("gap") - maths.label_gap(F.col("q"), F.col("label"))).alias("difference"))),
        f"WITH {v.LOGITS} SELECT prompt, round(sum(gap - (q[label + 1] - list_max(list_transform(q, lambda x: CASE WHEN x = q[label + 1] THEN -1.0 ELSE x END)))), 6) AS difference FROM gaps GROUP BY prompt",
    )
    e["a23_partial_sums"] = Entry(
        lambda s, d: _round(v.table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("rank"), "l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")).groupBy("l_returnflag").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))),
        "SELECT l_returnflag, round(sum(l_quantity), 6) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    )
    e["a24_class_sizes"] = Entry(lambda s, d: v.fewshot(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), f"WITH {v.FEWSHOT} SELECT label, count(*) AS n FROM fewshot GROUP BY label")

    # Windows
    for name, last, order in (("w01_first_shots", False, "doc_id"), ("w02_last_shots", True, "doc_id DESC")):
        e[name] = Entry(lambda s, d, last=last: sampling.few_shot(v.fewshot(s, d), "label", "doc_id", 16, last).select("label", "doc_id"), f"WITH {v.FEWSHOT} SELECT label, doc_id FROM fewshot QUALIFY row_number() OVER (PARTITION BY label ORDER BY {order}) <= 16")
    e["w03_running_mean"] = Entry(lambda s, d: _round(metrics.running_mean(v.table(s, d, "events").withColumn("w", F.col("event_id") + 1), "value", "w", ["user_id"], "event_id").select("event_id", "running")), "SELECT event_id, round(sum(value * (event_id + 1)) OVER w / sum(event_id + 1) OVER w, 6) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
    e["w04_best_so_far"] = Entry(lambda s, d: metrics.patience(v.table(s, d, "events"), "value", ["user_id"], "event_id").select("event_id", "best"), "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
    e["w05_patience"] = Entry(
        lambda s, d: metrics.patience(v.table(s, d, "events"), "value", ["user_id"], "event_id").select("event_id", F.col("waited").cast("bigint").alias("waited")),
        "WITH a AS (SELECT user_id, event_id, value, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM events), b AS (SELECT *, sum(CAST(better AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS waited FROM b",
    )
    e["w06_one_per_group"] = Entry(lambda s, d: sampling.one_per_group(v.table(s, d, "events"), ["user_id"], "event_id", 33).select("user_id", "event_id"), "SELECT user_id, arg_min(event_id, md5('33|' || event_id)) AS event_id FROM events GROUP BY user_id")
    e["w07_moving_average"] = Entry(
        lambda s, d: _round(v.table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x")).select("user_id", F.aggregate(F.slice("x", F.lit(2), F.size("x")), F.col("x")[0]["value"], lambda a, y: a * 0.9 + y["value"] * 0.1).alias("mean"))),
        "WITH x AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda a, y: a * 0.9 + y * 0.1), 6) AS mean FROM x",
    )
    e["w08_index_in_file"] = Entry(lambda s, d: v.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("random_id", "line")).select("doc_id", F.col("random_id").cast("bigint").alias("random_id"), F.md5("line").alias("h")), "SELECT doc_id, unnest(range(len(l))) AS random_id, md5(unnest(l)) AS h FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
    e["w09_rank"] = Entry(lambda s, d: v.table(s, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).cast("bigint").alias("place")), "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS place FROM events")

    # Order and limits
    e["t01_sorted_names"] = Entry(lambda s, d: v.table(s, d, "nation").select("n_name").distinct().orderBy("n_name"), "SELECT DISTINCT n_name FROM nation ORDER BY n_name")
    e["t02_top_three"] = Entry(lambda s, d: v.table(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(3).select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3")
    e["t03_top_share"] = Entry(
        lambda s, d: (lambda c: c.withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))).join(c.groupBy("c_mktsegment").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * 0.1)).alias("k")), "c_mktsegment").where("r <= k").select("c_mktsegment", "c_custkey"))(v.table(s, d, "customer")),
        "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= greatest(1, floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.1))",
    )
    for name, sign in (("t04_first_best", "-"), ("t05_last_best", "")):
        e[name] = Entry(lambda s, d, sign=sign: v.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_quantity", (-F.col("l_orderkey") if sign else F.col("l_orderkey")))).alias("order_")), f"SELECT l_suppkey, arg_max(l_orderkey, struct_pack(a := l_quantity, b := {sign}l_orderkey)) AS order_ FROM lineitem GROUP BY l_suppkey")
    e["t06_head"] = Entry(lambda s, d: v.table(s, d, "conversations").orderBy("conv_id", "turn").limit(10).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 10")

    # Sampling
    e["r01_one_per_conversation"] = Entry(lambda s, d: sampling.one_per_group(v.table(s, d, "conversations"), ["conv_id"], "turn", 33).select("conv_id", "turn"), "SELECT conv_id, arg_min(turn, md5('33|' || turn)) AS turn FROM conversations GROUP BY conv_id")
    e["r02_exact_splits"] = Entry(
        lambda s, d: sampling.split(v.table(s, d, "documents").select("doc_id"), "doc_id", 5, {"train": 0.6, "valid": 0.15, "test": 0.2}),
        "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('5|' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents), s AS (SELECT doc_id, CASE WHEN r < CAST(floor(n * 0.6) AS INT) THEN 'train' WHEN r < floor(n * 0.6) + floor(n * 0.15) THEN 'valid' WHEN r < floor(n * 0.6) + floor(n * 0.15) + floor(n * 0.2) THEN 'test' END AS split FROM r) SELECT doc_id, split FROM s WHERE split IS NOT NULL",
    )
    e["r03_share"] = Entry(lambda s, d: sampling.split(v.table(s, d, "documents").select("doc_id"), "doc_id", 66, {"train": 0.25}).select("doc_id"), "SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5('66|' || doc_id), doc_id) <= floor(count(*) OVER () * 0.25)")
    e["r04_few_shot"] = Entry(
        lambda s, d: (lambda f: sampling.few_shot(f, "label", "doc_id", 16).withColumn("split", F.lit("train")).unionByName(sampling.few_shot(sampling.few_shot(f, "label", "doc_id", 16).drop("shot"), "label", "doc_id", 16, True).withColumn("split", F.lit("validation"))).select("split", "label", "doc_id"))(v.fewshot(s, d)),
        f"WITH {v.FEWSHOT}, t AS (SELECT label, doc_id FROM fewshot QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= 16) SELECT 'train' AS split, * FROM t UNION ALL SELECT 'validation', * FROM t",
    )
    e["r05_vocabulary_share"] = Entry(lambda s, d: sampling.split(v.vocabulary(s, d), "token", 3, {"kept": 0.01}).select("token", "score"), f"WITH {v.VOCAB} SELECT token, score FROM vocab QUALIFY row_number() OVER (ORDER BY md5('3|' || token), token) <= floor(count(*) OVER () * 0.01)")
    for name, n, seed in (("r06_batch", 64, 11), ("r07_choice", 5, 12)):
        e[name] = Entry(lambda s, d, n=n, seed=seed: sampling.sample_rows(v.table(s, d, "documents"), "doc_id", n, seed).select("doc_id"), f"SELECT doc_id FROM documents ORDER BY md5('{seed}|' || doc_id) LIMIT {n}")

    # Sets
    c = lambda s, d: v.table(s, d, "conversations")
    e["u01_concatenated"] = Entry(lambda s, d: c(s, d).where("role = 'user'").select("conv_id", "turn").unionByName(c(s, d).where("role = 'system'").select("conv_id", "turn")), "SELECT conv_id, turn FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn FROM conversations WHERE role = 'system'")
    e["u02_union"] = Entry(lambda s, d: v.table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).union(v.table(s, d, "customer").select("c_nationkey")).distinct(), "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
    e["u03_multiset_intersection"] = Entry(lambda s, d: v.table(s, d, "lineitem").select("l_suppkey", "l_linenumber").where("l_returnflag = 'R'").intersectAll(v.table(s, d, "lineitem").where("l_returnflag = 'A'").select("l_suppkey", "l_linenumber")), "SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
    e["u05_absent_appended"] = Entry(lambda s, d: v.table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct().unionByName(v.table(s, d, "nation").select(F.col("n_nationkey").alias("k")).join(v.table(s, d, "supplier"), F.col("k") == F.col("s_nationkey"), "left_anti").select("k")), "SELECT DISTINCT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
    e["u06_multiset_difference"] = Entry(lambda s, d: v.table(s, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey").exceptAll(v.table(s, d, "lineitem").where("l_returnflag = 'A'").select("l_suppkey")), "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")

    # Numbers
    probs = lambda s, d: _scored(s, d)
    e["m01_softmax"] = Entry(lambda s, d: _round(probs(s, d).select("example", F.posexplode("p").alias("k", "p")).withColumn("k", F.col("k").cast("bigint"))), f"WITH {v.LOGITS} SELECT example, unnest(range(10)) AS k, round(unnest(p), 6) AS p FROM soft")
    e["m02_entropy"] = Entry(lambda s, d: _round(probs(s, d).select("example", maths.entropy(F.col("p")).alias("entropy"))), f"WITH {v.LOGITS} SELECT example, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy FROM soft")
    e["m03_gap"] = Entry(lambda s, d: _round(probs(s, d).select("example", "gap", (F.col("gap") > 0).alias("correct"))), f"WITH {v.LOGITS} SELECT example, round(gap, 6) AS gap, gap > 0 AS correct FROM gaps")
    e["m04_gap_reward"] = Entry(lambda s, d: _round(probs(s, d).select("example", maths.gap_reward(F.col("gap")).alias("reward")), 5), f"WITH {v.LOGITS} SELECT example, round(gap * CASE WHEN gap > 0 THEN 200 ELSE 180 END, 5) AS reward FROM gaps")
    e["m05_ce_reward"] = Entry(lambda s, d: _round(probs(s, d).select("example", maths.cross_entropy_of_probabilities(F.col("p"), F.col("label")).alias("reward"))), f"WITH {v.LOGITS} SELECT example, round(own - ln(list_sum(list_transform(p, lambda x: exp(x)))), 6) AS reward FROM gaps")
    moments = lambda l: l.select(F.posexplode("logits").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).agg(F.array_sort(F.collect_list(F.struct("k", "m", "v"))).alias("s"))
    e["m06_standardised"] = Entry(
        lambda s, d: (lambda l: _round(l.crossJoin(F.broadcast(moments(l))).select("example", F.posexplode(maths.standardised(F.col("logits"), F.col("s.m"), F.col("s.v"))).alias("k", "x")).withColumn("k", F.col("k").cast("bigint")), 5))(v.logits(s, d)),
        f"WITH {v.LOGITS}, x AS (SELECT example, unnest(range(10)) AS k, unnest(logits) AS x FROM logits), m AS (SELECT k, avg(x) AS m, var_samp(x) AS v FROM x GROUP BY k) SELECT example, k, round((x - m) / sqrt(v), 5) AS x FROM x JOIN m USING (k)",
    )
    e["m07_sigmoid"] = Entry(lambda s, d: _round(v.table(s, d, "events").select("event_id", maths.sigmoid(F.col("value") / 100).alias("p"))), "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS p FROM events")
    e["m10_ngrams"] = Entry(
        lambda s, d: v.table(s, d, "benchmark").select("item_id", F.explode(F.transform(maths.ngrams(maths.padded(strings.tokens(F.col("text")), 3, "<s>", "</s>"), 3), lambda g: F.array_join(g, " "))).alias("gram")).groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("n")),
        "WITH t AS (SELECT item_id, ['<s>', '<s>'] || list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') || ['</s>', '</s>'] AS w FROM benchmark), g AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM t) SELECT item_id, gram, count(*) AS n FROM g GROUP BY ALL",
    )
    e["m11_geometric_mean"] = Entry(lambda s, d: _round(v.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.exp(F.avg(F.ln("l_extendedprice"))).alias("mean")), 3), "SELECT l_suppkey, round(exp(avg(ln(l_extendedprice))), 3) AS mean FROM lineitem GROUP BY l_suppkey")
    e["m12_keyword_weights"] = Entry(lambda s, d: _round(v.table(s, d, "documents").select("doc_id", F.explode(F.split("text", "[ \n]")).alias("w")).where("w <> ''").groupBy("doc_id").agg(F.sum(F.when(F.col("w").isin("for", "if", "is", "in", "and", "or", "not", "with", "from", "as"), 1.0).otherwise(0.2)).alias("weight")), 3), "SELECT doc_id, round(sum(CASE WHEN w IN ('for','if','is','in','and','or','not','with','from','as') THEN 1.0 ELSE 0.2 END), 3) AS weight FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id")
    e["m13_json"] = Entry(lambda s, d: v.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].cast("bigint").alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
    e["m14_kl"] = Entry(lambda s, d: _round(probs(s, d).select("example", maths.kl(F.col("p"), F.col("q")).alias("kl"))), f"WITH {v.LOGITS} SELECT example, round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2]))), 6) AS kl FROM soft")
    return e
