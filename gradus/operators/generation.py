"""Completion, program execution and the rewriting of tasks."""

from __future__ import annotations

import hashlib
import os
import resource
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import strings
from ..functions.code import column, docstring, parameters, replaced_docstring


class Completer(Protocol):
    """What answers prompts; it must be picklable and is called in the workers."""

    def complete(self, prompts: list[str]) -> list[str | None]: ...


class StubCompleter:
    """A deterministic stand-in for a model: answers by the md5 of the prompt."""

    def __init__(self, pattern: str = "<scenario>case {digest}</scenario><context>setting {digest}</context><instruction>Do {digest}.</instruction> yes"):
        self.pattern = pattern

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [self.pattern.replace("{digest}", hashlib.md5(p.encode()).hexdigest()[:8]) for p in prompts]


def completed(rows: DataFrame, completer: Completer, prompt: str = "prompt", retries: int = 10, wait: float = 60.0, batch: int = 100, pause: float | None = None) -> DataFrame:
    """``rows`` with ``answer`` and ``cost_time``. A failed prompt is retried by itself; after that its answer is the empty text.

    A task asks for ``batch`` prompts at a time and rests ``pause`` seconds (as long as ``wait``, unless
    given) before the next.

    The answer stays with its row, so failures shift nothing. Persist or write
    the result: the call is neither cheap nor repeatable.
    """
    schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, answer string, cost_time double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = 0
        for rows in batches:
            answers, began = [], time.time()
            for at in range(0, rows.num_rows, batch):
                # Only the prompts that are asked for now become Python values; the other columns stay as they came.
                part = rows[prompt].slice(at, batch).to_pylist()
                if asked and asked + len(part) > batch:
                    time.sleep(wait if pause is None else pause)
                    asked = 0
                asked += len(part)
                got = completer.complete(part)
                for k, answer in enumerate(got):
                    for tries in range(retries):
                        if answer is not None:
                            break
                        if tries:
                            time.sleep(wait)
                        answer = completer.complete([part[k]])[0]
                    answers.append(answer or "")
            cost = (time.time() - began) / max(1, rows.num_rows)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string()), pa.array([cost] * rows.num_rows, pa.float64())], names=[*rows.schema.names, "answer", "cost_time"])

    return rows.mapInArrow(run, schema)


#: Part of a minute that clocks of executors may differ by, and that a batch may be late in its window.
TOLERANCE = 0.1


def paced(rows: DataFrame, completer: Completer, prompt: str = "prompt", limit: int = 100, minute: float = 60.0, partitions: int = 8, retries: int = 10) -> DataFrame:
    """``rows`` with ``answer``: no more than ``limit`` requests in any minute over all tasks together.

    Time is cut into windows of a minute (and a little), and batches of ``limit`` prompts are numbered over all
    partitions by a prefix sum of their counts. Of N batches, number k may be asked in the windows k,
    k + N, k + 2N and so on, within the first ``TOLERANCE`` of one: no window is another batch's, so a
    task that starts late waits for its next one and never shares. Failed prompts come again in a later window of
    their task, ahead of those not yet asked, and are the empty text after ``retries`` of them. The result is
    not repeatable: persist or write it.
    """
    part = F.pmod(F.xxhash64(prompt), F.lit(partitions)).cast("int")
    held = rows.withColumn("__part", part)
    # One number a partition.
    counts = {r["__part"]: -(-r["count"] // limit) for r in held.groupBy("__part").count().collect()}
    first, whole = {}, 0
    for p in range(partitions):
        first[p] = whole
        whole += counts.get(p, 0)
    width, began = minute * (1 + 2 * TOLERANCE), time.time()
    names = rows.columns

    def wait(slots: range) -> None:
        """Sleep until the next window of one of the slots begins."""
        now = (time.time() - began) / width
        # A window that has just begun will do; the minute between two starts is kept by the windows' width.
        turn = now if now % 1 <= TOLERANCE / (1 + 2 * TOLERANCE) else int(now) + 1
        due = min((s + whole * max(0, -(-(int(turn) - s) // whole)) for s in slots))
        time.sleep(max(0.0, began + due * width - time.time()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue: list[tuple[int, dict]] = []
        slots, last = None, None

        def ask() -> pd.DataFrame:
            nonlocal last
            while True:
                wait(slots)
                window = int((time.time() - began) / width)
                if window != last:
                    break
                time.sleep(width * 2 * TOLERANCE)
            last = window
            own, queue[:limit] = queue[:limit], []
            done, again = [], []
            for (tries, row), answer in zip(own, completer.complete([row[prompt] for _, row in own])):
                if answer is None and tries + 1 < retries:
                    again.append((tries + 1, row))
                else:
                    done.append(row | {"answer": answer or ""})
            queue[:0] = again
            return pd.DataFrame(done, columns=[*names, "answer"])

        for frame in frames:
            if slots is None and len(frame):
                p = int(frame["__part"].iloc[0])
                slots = range(first[p], first[p] + counts[p])
            queue += [(0, row) for row in frame[names].to_dict("records")]
            while len(queue) >= limit:
                yield ask()
        while queue:
            yield ask()

    return held.repartitionById(partitions, F.col("__part")).mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, answer string")


def execute(source: str, seconds: float = 3.0, megabytes: int = 512) -> tuple[bool, str]:
    """Run a program in a child interpreter of its own: (exit code is 0, standard error or 'timeout').

    Isolated mode, an empty environment, a temporary working folder and limits
    on memory, CPU time, file size and processes.
    """

    def limit():
        os.setsid()
        for what, most in ((resource.RLIMIT_AS, megabytes << 20), (resource.RLIMIT_CPU, int(seconds) + 1), (resource.RLIMIT_FSIZE, 16 << 20), (resource.RLIMIT_CORE, 0)):
            resource.setrlimit(what, (most, most))

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "program.py")
        with open(path, "w") as f:
            f.write(source)
        child = subprocess.Popen([sys.executable, "-I", "-S", path], cwd=folder, env={}, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, preexec_fn=limit)
        try:
            _, error = child.communicate(timeout=seconds)
            return child.returncode == 0, error.decode(errors="replace")
        except subprocess.TimeoutExpired:
            os.killpg(child.pid, signal.SIGKILL)
            child.communicate()
            return False, "timeout"


#: Part of a bin's load from which a program is placed by itself; stretches of the order of all others.
LARGE, STRETCHES = 0.05, 4096


def balanced(rows: DataFrame, key: str, cost: str, bins: int) -> DataFrame:
    """``rows`` in ``bins`` partitions of about equal sums of ``cost`` (predicted seconds, above 0), with ``bin``.

    Rows that cost more than ``LARGE`` of a bin's fair share, fewer than bins / LARGE, are placed longest first into
    the bin with least load. The others follow one another in the order of an md5 of their key, and the sum of
    costs before a row tells the bin whose room it falls in: a prefix sum over stretches of that order, then within each. So a bin
    exceeds its room by one small row at most. ``key`` tells rows apart.
    """
    spark = rows.sparkSession
    whole = rows.agg(F.sum(cost)).first()[0] or 0.0
    own = rows.withColumn("__order", F.md5(F.col(key).cast("string"))).withColumn("__stretch", F.conv(F.substring("__order", 1, 3), 16, 10).cast("int"))
    least = float(whole) / bins * LARGE
    large = own.where(F.col(cost) > least).select(key, F.col(cost).cast("double").alias("c")).collect()
    load, place = [0.0] * bins, []
    for r in sorted(large, key=lambda r: (-r["c"], str(r[key]))):
        b = load.index(min(load))
        load[b] += r["c"]
        place.append((r[key], b))
    # Room left under one level for all bins, found by filling the emptiest first.
    rest, level = float(whole) - sum(load), 0.0
    for n in range(bins, 0, -1):
        level = (sum(sorted(load)[:n]) + rest) / n
        if n == 1 or sorted(load)[n - 1] <= level:
            break
    ends, total = [], 0.0
    for x in load:
        total += max(0.0, level - x)
        ends.append(total)
    sums = {r["__stretch"]: r["s"] for r in own.where(F.col(cost) <= least).groupBy("__stretch").agg(F.sum(cost).alias("s")).collect()}
    starts, total = [], 0.0
    for k in range(STRETCHES):
        starts.append((k, total))
        total += float(sums.get(k, 0.0))
    # A number a stretch, a bin for each large row: bounded tables.
    before = F.broadcast(spark.createDataFrame(starts, "__stretch int, __start double"))
    placed = F.broadcast(spark.createDataFrame(place, f"`{key}` {dict(rows.dtypes)[key]}, __bin int"))
    inside = F.sum(cost).over(Window.partitionBy("__stretch").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1))
    small = own.where(F.col(cost) <= least).withColumn("__inside", F.coalesce(inside, F.lit(0.0))).join(before, "__stretch")
    bin_ = F.size(F.filter(F.array(*map(F.lit, ends[:-1])), lambda e: e <= F.col("__start") + F.col("__inside"))) if bins > 1 else F.lit(0)
    out = small.select(*rows.columns, bin_.cast("int").alias("bin"))
    if place:
        out = out.unionByName(own.where(F.col(cost) > least).join(placed, key).select(*rows.columns, F.col("__bin").alias("bin")))
    return out.repartitionById(bins, F.col("bin"))


def executed(programs: DataFrame, seconds: float = 3.0, partitions: int | None = None) -> DataFrame:
    """``programs`` (with ``program``) with ``passed`` and ``error``. Spread first: programs' costs differ widely."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in programs.dtypes)}, passed boolean, error string"

    def run(frames):
        for frame in frames:
            got = [execute(p, seconds) for p in frame["program"]]
            yield frame.assign(passed=[g[0] for g in got], error=[g[1] for g in got])

    spread = programs.repartition(partitions) if partitions else programs
    return spread.mapInPandas(run, schema)


def validated(tasks: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Tasks whose solution passes its tests; those that time out stay."""
    gone = ~F.col("passed") & (F.col("error") != "timeout")
    return executed(tasks, seconds).where(~gone).drop("passed", "error")


def samples(tasks: DataFrame, n: int, temperature: float = 0.8) -> DataFrame:
    """Every task n times (once at temperature 0) with sample_id from 0."""
    return tasks.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit((n if temperature else 1) - 1))))


# Prompts of our own wording; their slots are what the operators fill.
SCENARIO_PROMPT = "Propose a new area and topic as <scenario>area:topic</scenario>, unlike these: {s1}; {s2}; {s3}; {s4}; {s5}. One example: {exp}"
CONTEXT_PROMPT = "A task reads: {pb}\nIts inputs are {var}. Set it in the scenario {scenario} and describe the setting as <context>...</context>."
REWRITE_PROMPT = "A task reads: {pb}\nInputs: {input_variables}. Rewrite it for {scenario} in {num} to {num_2} sentences as <instruction>...</instruction>."
VERIFY_PROMPT = "Do these ask for the same program? One: {inst_a}\nOther: {inst_b}\nAnswer yes or no."


SLOTS = 5


def proposed_scenarios(seeds: DataFrame, completer: Completer, wanted: int, prompts: int = 10, seed: int = 7) -> DataFrame:
    """name and text of all seeds and of the scenarios found: rounds of ten prompts over a growing pool until it has more than ``wanted``.

    ``seeds`` has name and text, any number of rows; they stay a DataFrame. A round takes each prompt's slots
    from the pool by md5 order (a top-k of ``SLOTS`` names a prompt) and brings at most its answers to the driver. There
    are no more rounds than scenarios wanted.
    """
    spark = seeds.sparkSession
    found: dict[str, str] = {}
    pool = seeds.select("name", "text").groupBy("name").agg(F.min("text").alias("text"))
    count = pool.count()
    for turn in range(wanted):
        if count + len(found) > wanted or not count + len(found):
            break
        everything = pool.unionByName(spark.createDataFrame(sorted(found.items()), "name string, text string")) if found else pool
        drawn = []
        for p in range(prompts):
            first = everything.orderBy(F.md5(F.concat(F.lit(f"{seed}|{turn}|{p}|"), "name")), "name").limit(SLOTS).collect()
            slots = {f"s{i + 1}": first[i % len(first)]["name"] for i in range(SLOTS)} | {"exp": first[0]["text"]}
            text = SCENARIO_PROMPT
            for k, v in slots.items():
                text = text.replace("{" + k + "}", v or "")
            drawn.append((turn * prompts + p, text))
        asked = completed(spark.createDataFrame(drawn, "id long, prompt string"), completer, wait=0)
        named = asked.select("id", F.explode(strings.tags(F.col("answer"), "scenario")).alias("name")).join(pool.select("name"), "name", "left_anti")
        for r in named.orderBy("id", "name").collect():
            found.setdefault(r["name"], r["name"])
    return pool.unionByName(spark.createDataFrame(sorted(found.items()), "name string, text string"))


def contexts(tasks: DataFrame, scenarios: DataFrame, completer: Completer, n: int, seed: int = 7) -> DataFrame:
    """task_id, scenario and context: n scenarios a task, drawn by md5, each with the first context of its answer; no answer, no row.

    Scenarios are numbered in the order of an md5; a task takes n numbers in a row (around the end)
    from a place that its md5 gives. So n rows a task are joined and no other pair is made.
    """
    order = F.md5(F.concat(F.lit(f"{seed}|"), "name"))
    total = scenarios.select("name").distinct().count()
    numbered = ranked(scenarios.select("name").distinct().withColumn("d", order), "d", "name").select(F.col("name").alias("scenario"), F.col("place").alias("k"))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("task_id").cast("string"))), 1, 13), 16, 10).cast("long")
    each = tasks.withColumn("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max(0, min(n, total) - 1))), lambda i: F.pmod(start + i, F.lit(max(1, total)))))).join(numbered, "k").select("task_id", "instruction", "inputs", "scenario")
    asked = each.withColumn("prompt", strings.template(CONTEXT_PROMPT, {"pb": F.col("instruction"), "var": F.col("inputs"), "scenario": F.col("scenario")}))
    found = strings.tags(F.col("answer"), "context")
    return completed(asked, completer, wait=0).withColumn("context", F.try_element_at(found, F.lit(1))).where("context IS NOT NULL").drop("prompt", "answer", "cost_time")


def ranked(rows: DataFrame, order: str, tie: str, bins: int = 4096) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in ``order`` (hexadecimal digits): ranks within the bins of its first digits, after a prefix sum over the bins."""
    own = rows.withColumn("__bin", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    counts, before, so_far = {r[0]: r[1] for r in own.groupBy("__bin").count().collect()}, [], 0
    for b in range(bins):
        before.append((b, so_far))
        so_far += counts.get(b, 0)
    # One narrow row a bin.
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "__bin int, __start long"))
    inside = F.row_number().over(Window.partitionBy("__bin").orderBy(order, tie)) - 1
    return own.withColumn("__inside", inside).join(starts, "__bin").withColumn("place", F.col("__start") + F.col("__inside")).drop("__bin", "__start", "__inside")


def rewritten(rows: DataFrame, completer: Completer) -> DataFrame:
    """Rows of contexts() with new_instruction; the bounds on its sentences follow the old one."""
    bound = strings.sentence_bound(F.col("instruction"))
    slots = {"pb": F.col("instruction"), "input_variables": F.col("inputs"), "scenario": F.concat_ws(": ", "scenario", "context"), "num": bound.cast("string"), "num_2": (bound + 1).cast("string")}
    asked = rows.withColumn("prompt", strings.template(REWRITE_PROMPT, slots))
    found = F.try_element_at(strings.tags(F.col("answer"), "instruction"), F.lit(1))
    return completed(asked, completer, wait=0).withColumn("new_instruction", found).where("new_instruction IS NOT NULL").drop("prompt", "answer", "cost_time")


def verified(rows: DataFrame, completer: Completer) -> DataFrame:
    """Rewrites for which the answer begins with yes."""
    asked = rows.withColumn("prompt", strings.template(VERIFY_PROMPT, {"inst_a": F.col("instruction"), "inst_b": F.col("new_instruction")}))
    return completed(asked, completer, wait=0).where(F.lower("answer").startswith("yes")).drop("prompt", "answer", "cost_time")


@lru_cache(maxsize=256)
def _replaced(source: str, name: str, text: str) -> str:
    """A task's rewrites stand together after the join: equal ones are rendered once."""
    return replaced_docstring(source, name, text)


def new_tasks(tasks: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Tasks with prefix and solution under the new docstring; joined on task_id, so a missing task gives no row."""
    both = tasks.join(rewrites.select("task_id", "new_instruction"), "task_id")
    doc = F.concat(F.lit("\n    "), F.trim("new_instruction"), F.lit("\n"), F.coalesce("demo_str", F.lit("")), F.lit("\n    "))
    replace = column(lambda s, n, d: _replaced(s, n, d))
    out = both.withColumn("doc_string", doc)
    return out.withColumn("solution", replace(F.col("solution"), F.col("entry_func"), F.col("doc_string"))).withColumn("prefix", replace(F.concat("prefix", F.lit("\n    pass")), F.col("entry_func"), F.col("doc_string")))


def described_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with docstring and inputs (the parameters' names)."""
    # One pass of Python over the solutions for both.
    found = column(lambda s, n: [docstring(s, n), ", ".join(parameters(s, n))], "array<string>")
    both = tasks.withColumn("__found", found(F.col("solution"), F.col("entry_func")))
    return both.withColumns({"docstring": F.get("__found", F.lit(0)), "inputs": F.get("__found", F.lit(1))}).drop("__found")


#: The part of a completion's answer that is read.
RESPONSE = "choices array<struct<text:string,message:struct<content:string>,logprobs:struct<tokens:array<string>,token_logprobs:array<double>>>>"


def text_and_logprobs(rows: DataFrame, response: str = "response") -> DataFrame:
    """``rows`` with text, tokens and logprobs of the first choice of a completion's JSON answer; the text of an answer that cannot be read is empty."""
    first = F.try_element_at(F.from_json(response, RESPONSE)["choices"], F.lit(1))
    text = F.coalesce(first["text"], first["message"]["content"], F.lit(""))
    return rows.withColumns({"text": text, "tokens": first["logprobs"]["tokens"], "logprobs": first["logprobs"]["token_logprobs"]})
