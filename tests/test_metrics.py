from itertools import product
from math import comb

import pytest
from pyspark.sql import functions as F

from gradus.functions import code, maths
from gradus.operators import metrics, sampling, search, similarity

REFERENCES = [
    "It is a guide to action that ensures that the military will forever heed Party commands",
    "It is the guiding principle which guarantees the military forces always being under the command of the Party",
    "It is the practical guide for the army always to heed the directions of the party",
]


def test_pass_at_k_equals_binomials(spark):
    rows = [(n, c) for n in range(1, 13) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "n int, c int")
    got = df.select("n", "c", *(maths.pass_at_k(F.col("n"), F.col("c"), k).alias(f"p{k}") for k in metrics.KS)).collect()
    for r, k in product(got, metrics.KS):
        n, c = r["n"], r["c"]
        want = 1.0 if n - c < k else 1 - comb(n - c, k) / comb(n, k)
        assert abs(r[f"p{k}"] - want) < 1e-12


def test_strict_pass_at_k(spark):
    df = spark.createDataFrame([(1, 0), (10, 3)], "n int, c int")
    assert [r[0] for r in df.select(maths.pass_at_k(F.col("n"), F.col("c"), 3, True)).collect()][0] is None


@pytest.mark.parametrize("hypothesis,reference,want", [("a b c d e", "a b c d e", 1.0), ("x y z", "a b c", 0.0)])
def test_bleu_ends(spark, hypothesis, reference, want):
    pairs = spark.createDataFrame([(1, hypothesis, reference)], "pair_id long, hypothesis string, reference string")
    assert abs(similarity.matches(pairs).select(similarity.bleu(1)).first()[0] - want) < 1e-9


@pytest.mark.parametrize("lengths,hypothesis,want", [((12, 15, 17), 12, 1.0), ((28, 28), 12, 0.263597), ((13, 2), 12, 0.9200), ((13, 11), 12, 1.0), ((11, 8), 7, 0.8668), ((11, 8, 6, 7), 7, 1.0)])
def test_brevity_penalty(spark, lengths, hypothesis, want):
    df = spark.createDataFrame([(list(lengths), hypothesis)], "l array<int>, h int")
    got = df.select(maths.brevity_penalty(maths.closest_length(F.col("l"), F.col("h")).cast("double"), F.col("h").cast("double"))).first()[0]
    assert abs(got - want) < 1e-4


def test_clipped_precision(spark):
    pairs = spark.createDataFrame([(1, "the the the the the the the", "the cat is on the mat")], "pair_id long, hypothesis string, reference string")
    r = similarity.matches(pairs).first()
    assert (r["num_1"], r["den_1"]) == (2, 7)


def bleu_row(spark, hypothesis, references, method=1, orders=4):
    rows = [(1, " ".join(hypothesis), [" ".join(r) for r in references])]
    return similarity.matches(spark.createDataFrame(rows, "pair_id long, hypothesis string, references array<string>"), orders).select("*", similarity.bleu(method).alias("bleu")).first()


HYPOTHESES = [
    "It is a guide to action which ensures that the military always obeys the commands of the party",
    "It is to insure the troops forever hearing the activity guidebook that party direct",
    "he read the book because he was interested in world history",
]


def test_golden_bleu(spark):
    refs = [r.split() for r in REFERENCES]
    assert abs(bleu_row(spark, HYPOTHESES[0].split(), refs)["bleu"] - 0.5045) < 1e-4
    rows = [(1, HYPOTHESES[0], REFERENCES), (2, HYPOTHESES[2], ["he was interested in world history because he read the book"])]
    both = similarity.matches(spark.createDataFrame(rows, "pair_id long, hypothesis string, references array<string>"))
    assert abs(similarity.corpus(both).select(similarity.bleu(1)).first()[0] - 0.5920) < 1e-4
    assert abs(both.agg(F.avg(similarity.bleu(1))).first()[0] - 0.6223) < 1e-4


@pytest.mark.parametrize("hypothesis,n,want", [(0, 1, 0.9444), (1, 1, 0.5714), (0, 2, 0.588235), (1, 2, 0.07692)])
def test_golden_precisions_over_three_references(spark, hypothesis, n, want):
    r = bleu_row(spark, HYPOTHESES[hypothesis].split(), [r.split() for r in REFERENCES])
    assert abs(r[f"num_{n}"] / r[f"den_{n}"] - want) < 1e-4


@pytest.mark.parametrize("method,want", [(0, 0.4118), (1, 0.4118), (2, 0.4489), (3, 0.4118), (4, 0.4118), (5, 0.4905), (6, 0.4135), (7, 0.4905)])
def test_golden_smoothing(spark, method, want):
    reference = "It is a guide to action that ensures that the military will forever heed Party commands".split()
    assert abs(bleu_row(spark, HYPOTHESES[0].split(), [reference], method, 5)["bleu"] - want) < 1e-4


def test_awkward_pairs(spark):
    rows = [(1, None, "a"), (2, "a", None), (3, "", ""), (4, "a", "a"), (5, "a b", "c d")]
    got = {r["pair_id"]: r for r in similarity.matches(spark.createDataFrame(rows, "pair_id long, hypothesis string, reference string"), 5).select("*", *(similarity.bleu(m).alias(f"m{m}") for m in range(8))).collect()}
    assert [got[k]["hyp_len"] for k in range(1, 6)] == [0, 1, 0, 1, 2]
    assert all(got[k][f"m{m}"] == 0 for k in (1, 2, 3, 5) for m in range(8))
    assert got[4]["m4"] is None and got[4]["m6"] is None and got[4]["m0"] > 0


def test_splits_are_exact_whatever_the_partitions(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k")
    found = []
    for n in (1, 7):
        got = sampling.split(rows.repartition(n), "k", 4, {"a": 0.5, "b": 0.25}).collect()
        found.append({r["k"]: r["split"] for r in got})
    assert found[0] == found[1]
    assert sorted(map(list(found[0].values()).count, ("a", "b"))) == [250, 501]
    with pytest.raises(ValueError):
        sampling.split(rows, "k", 4, {"a": 0.9, "b": 0.2})


def test_searches_find_the_best_word():
    def scorer(prompts):
        return [sum(w == "good" for w in p.split()) / 3 for p in prompts]

    words = ["bad", "good", "worse"]
    assert search.greedy(words, scorer, 3)[0] == "good good good"
    for find in (search.genetic, search.swarm):
        text, path = find(words, scorer, population=20, rounds=12, length=3)
        assert path == sorted(path) and scorer([text])[0] >= 2 / 3
    assert search.edit_search("good bad", scorer, 2)[1][0] == 1 / 3


def test_data_flow_of_branches_and_loops():
    branch = code.data_flow("x = 1\nif c:\n    x = 2\ny = x\n")
    # Both definitions reach the read: one name, two places.
    assert branch == [("x", 0, "computedFrom", (), ()), ("x", 2, "computedFrom", (), ()), ("y", 3, "computedFrom", ("x",), (4,)), ("x", 4, "comesFrom", ("x",), (0, 2))]
    assert code.normalised_flow(branch) == [("var_0", "computedFrom", ()), ("var_0", "computedFrom", ()), ("var_1", "computedFrom", ("var_0",)), ("var_0", "comesFrom", ("var_0",))]
    twice = code.data_flow("a = 0\nfor i in r:\n    a = a + i\n")
    assert any(e[0] == "a" and e[2] == "comesFrom" and len(e[4]) == 2 for e in twice)


def test_mutants_differ_by_one_edit(spark):
    from gradus.operators import mutation

    df = spark.createDataFrame([("word",), ("a",), ("",)], "w string")
    got = {r["w"]: r["m"] for r in df.select("w", mutation.mutants(F.col("w"), F.lit("1")).alias("m")).collect()}
    assert len(got["word"]) == 3 + 4 + 4 + 4 and len(got["a"]) == 1 and got[""] == []
