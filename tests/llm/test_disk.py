"""What the operators leave on disk and send from task to task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import common, graph, op4_lines, op7_jaccard


def shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    setting, before = spark.conf.get(common._ENDS, None), shuffled(spark)
    out = common.written(spark.range(1000).repartition(4, "id"), "dealt")
    assert not shuffled(spark) - before
    assert spark.conf.get(common._ENDS, None) == setting and out.count() == 1000


def test_setting_is_kept_where_tables_are_written_side_by_side(spark):
    spark.conf.set(common._ENDS, "false")
    with common.emptied(spark):
        with common.emptied(spark):
            pass
        assert spark.conf.get(common._ENDS) == "true"
    assert spark.conf.get(common._ENDS) == "false"
    spark.conf.unset(common._ENDS)


def test_op4_substrings_counted_leave_no_shuffle_files(spark):
    docs = spark.createDataFrame([(k, f"one line of some length that several documents have, and {k} of them" + " too" * 30) for k in range(60)], "doc_id long, text string")
    before = shuffled(spark)
    assert len(op4_lines.crowded_grams(docs, 2, 1))
    assert not shuffled(spark) - before


def spanned_sizes(monkeypatch) -> list[int]:
    """The largest group of each call of ``graph.spanned`` by an operator."""
    sizes, real = [], graph.spanned

    def spanned(groups, *args):
        sizes.append(groups.groupBy("c").count().agg(F.max("count")).first()[0])
        return real(groups, *args)

    monkeypatch.setattr(graph, "spanned", spanned)
    return sizes


def sets(seed: int) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    out = []
    for n in (1, 2, 30, 250, 257, 500, 520, 3000, 40_000):
        base = r.integers(-(2**63), 2**63 - 1, n)
        out += [base] + [np.unique(np.concatenate((base[int(n * share) :], r.integers(-(2**63), 2**63 - 1, int(n * share))))) for share in (0, 0.02, 0.05, 0.3, 0.9)]
    return [np.unique(x) for x in out]


@pytest.mark.parametrize("percent", [40, 80, 90])
def test_sketches_part_no_linked_sets(percent):
    own = sets(percent)
    n = np.array([len(x) for x in own])

    def bound(a, b):
        return np.where(100 * np.minimum(a, b) >= percent * np.maximum(a, b), a + b - 2 * -(-(a + b) * percent // (100 + percent)), -1)

    everything = np.arange(len(own))
    for left, right in ((everything, everything), (everything[::2], everything[1::2])):
        right = left if len(left) == len(own) else right
        found = graph.alike([([graph.sketch(x, len(x)) for x in own], left, right)], bound)[0]
        root = graph.forest(len(own), found)
        for i in left.tolist():
            for j in right.tolist():
                common_ = len(np.intersect1d(own[i], own[j]))
                if 100 * common_ >= percent * (n[i] + n[j] - common_):
                    assert root[i] == root[j]
    assert len(set(root)) > 1


def test_sketches_of_lines_part_none_within_the_distance():
    r = random.Random(4)
    for length in (1, 3, 4, 24, 60, 149, 150, 400, 1500):
        line = "".join(r.choices("abcdefgh ", k=length))
        lines = [line]
        for _ in range(30):
            chars = list(line)
            for _ in range(max(2, length // 50)):
                at = r.randrange(len(chars) + 1)
                chars[at : at + r.choice((0, 1))] = r.choice(("", "x", "ß"))
            lines.append("".join(chars))
        rows = [op4_lines.outlined(x) for x in lines]
        found = graph.alike([(rows, np.arange(len(rows)), np.arange(1))], lambda a, b: op4_lines.differing(a, b, 2))[0]
        root = graph.forest(len(rows), found)
        for k, other in enumerate(lines):
            most = max(2, min(len(line), len(other)) // 50)
            assert op4_lines.edit_distance(line, other, most) > most or root[k] == root[0]


def test_op7_unlike_sets_of_one_group_are_parted_before_they_are_sent(spark, monkeypatch):
    r = random.Random(1)
    passage = " ".join(str(r.random()) for _ in range(40))
    texts = [passage + " " + " ".join(str(r.random()) for _ in range(60)) for _ in range(200)]
    texts += [f"{x} end" for x in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = common.written(op7_jaccard.sets(docs, 3, 90), "sets")
    reps = whole.select("v", "doc_id", "n", "spare", "low")
    sizes = spanned_sizes(monkeypatch)
    edges = op7_jaccard.linked(docs, reps, reps.select("v", F.lit(7).cast("long").alias("c")), 3, 90, 4)
    name = {x["v"]: x["doc_id"] for x in reps.collect()}
    assert {tuple(sorted((name[a], name[b]))) for a, b in edges.collect()} == {(0, 200), (1, 201), (2, 202)}
    assert sizes[0] == 203 and sizes[-1] == 2


def test_op4_unlike_lines_of_one_group_are_parted_before_they_are_sent(spark, monkeypatch):
    r = random.Random(2)
    passage = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    lines = [passage + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(200)]
    lines += [x + "!" for x in lines[:3]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    star = [(x, y) for x, y in zip(range(1, 203), [0] * 202)]
    names = [x["h"] for x in op4_lines.line_rows(docs, 1).orderBy("doc_id").collect()]
    monkeypatch.setattr(op4_lines, "stars", lambda *_: spark.createDataFrame([(names[a], names[b]) for a, b in star], "a long, b long"))
    sizes = spanned_sizes(monkeypatch)
    gone = op4_lines.repeats(docs).select("doc_id").collect()
    assert sorted(x[0] for x in gone) == [200, 201, 202]
    assert sizes[0] == 203 and sizes[-1] == 2
