"""Words at a mark, tags, phrases, pacing and balanced execution."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import generation, infill, mutation, phrases, tagging

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "the cat ate the old dog", "a dog ate a cat", None, "", "one"]


@pytest.fixture(scope="module")
def model(spark):
    counted = infill.triples(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    return infill.fit(counted.persist())


def by_hand(u, w, v):
    """Kneser-Ney from the definition, over lists of triples."""
    all_ = []
    for t in TEXTS:
        own = ["<s>", *(t or "").split(), "</s>"]
        all_ += [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    kinds, d = set(all_), infill.DISCOUNT

    def level(rows, lower):
        total = len(rows)
        if not total:
            return lower
        words = [r[1] for r in rows]
        return max(words.count(w) - d, 0) / total + d * len(set(words)) / total * lower

    base = sum(k[1] == w for k in kinds) / len(kinds)
    forward, backward = level([k for k in kinds if k[0] == u], base), level([k for k in kinds if k[2] == v], base)
    return level([x for x in all_ if x[0] == u and x[2] == v], (forward + backward) / 2)


def test_words_at_a_place_sum_to_one_and_equal_the_definition(spark, model):
    places = spark.createDataFrame([("the", "sat"), ("cat", "on"), ("unseen", "dog"), ("unseen", "other"), ("<s>", "</s>")], "u string, v string")
    got = infill.scored(places.crossJoin(model.any.select("w")), model).collect()
    for u, v in {(r["u"], r["v"]) for r in got}:
        own = [r for r in got if (r["u"], r["v"]) == (u, v)]
        assert abs(sum(r["p"] for r in own) - 1) < 1e-12
        for r in own:
            assert abs(r["p"] - by_hand(u, r["w"], v)) < 1e-12
    best = {(r["u"], r["v"]): r["w"] for r in infill.best(places, model).collect()}
    for u, v in best:
        assert best[u, v] == min((-r["p"], r["w"]) for r in got if (r["u"], r["v"]) == (u, v))[1]


def test_marks_are_filled_with_the_best_word(spark, model):
    rows = spark.createDataFrame([(1, "The [MASK] sat on the mat"), (2, "no mark"), (3, "[MASK]"), (4, None)], "k int, prompt string")
    got = {r["k"]: r["mutated"] for r in infill.filled(rows, model).collect()}
    assert got == {1: "The cat sat on the mat", 3: "one"} or got[1] in ("The cat sat on the mat", "The dog sat on the mat") and set(got) == {1, 3}
    empty = infill.fit(infill.triples(spark.createDataFrame([], "text string")))
    assert {r["k"]: r["mutated"] for r in infill.filled(rows, empty).collect()} == {1: "The  sat on the mat", 3: ""}


def test_best_path_of_tags_equals_all_paths():
    tagger = tagging.Tagger()
    for text in ("the old dog", "dogs run quickly", "7 cats", "she is happy .", "running of the", "x"):
        own = np.array([tagging.shape(w) for w in text.split(" ")])
        best = max(tagger.worth(own, p) for p in itertools.product(range(len(tagging.TAGS)), repeat=len(own)))
        assert abs(tagger.worth(own, tagger.path(own)) - best) < 1e-9
    assert [tagging.TAGS[k] for k in tagger.path(np.array([tagging.shape(w) for w in "the famous nation has 12 dogs".split()]))] == ["DET", "ADJ", "NOUN", "VERB", "NUM", "NOUN"]


def test_nouns_and_adjectives_are_masked(spark):
    rows = spark.createDataFrame([(1, "write the famous function of a list quickly now"), (2, None), (3, ""), (4, "a")], "k int, text string")
    tagger = tagging.fit(rows, rounds=2)
    got = tagging.tagged(rows, tagger)
    tags = {r["k"]: r["tags"] for r in got.collect()}
    assert tags[2] is None and len(tags[1]) == 9 and len(tags[3]) == 1 and tags[1][1] == "DET" and tags[1][2] == "ADJ"
    places = {(r["k"], r["place"]) for r in mutation.masked(got, "k", "text", maskable=F.col("maskable")).collect()}
    assert places == {(1, i) for i, t in enumerate(tags[1]) if t in ("NOUN", "ADJ") and 0 < i < 8} and len(places) >= 2


def test_best_trees_equal_enumeration():
    rules, lexical = phrases.RULES, phrases.LEXICAL

    def every(tags):
        """Best weight of each name over the tags, by trying all cuts without a chart."""
        out = {}
        if len(tags) == 1:
            out = {tags[0]: 0.0, **lexical.get(tags[0], {}), "S": phrases.WORD}
        for k in range(1, len(tags)):
            left, right = every(tags[:k]), every(tags[k:])
            for to, a, b, w in rules:
                if a in left and b in right:
                    out[to] = max(out.get(to, -1e9), left[a] + right[b] + w)
        for name, w in phrases.WHOLE.items():
            if name in out:
                out["S"] = max(out.get("S", -1e9), out[name] + w)
        return out

    def weight(tree):
        name, i, j, parts = tree
        if len(parts) == 1:
            return weight(parts[0]) + phrases.WHOLE[parts[0][0]]
        if parts:
            return sum(map(weight, parts)) + max(w for to, a, b, w in rules if (to, a, b) == (name, parts[0][0], parts[1][0]))
        return 0.0 if name == tags[i] else phrases.WORD if name == "S" else lexical[tags[i]][name]

    r = np.random.default_rng(2)
    for n in range(1, 9):
        for _ in range(6 if n < 7 else 2):
            tags = [str(x) for x in r.choice(tagging.TAGS, n)]
            best, tree = phrases.parse(tags)
            assert abs(best - every(tags)["S"]) < 1e-9 and abs(weight(tree) - best) < 1e-9
            spans = phrases.lowest(tree)
            assert [i for a, b in spans for i in range(a, b)] == list(range(n))


def test_phrases_hold_every_word(spark):
    texts = [(1, "The old dog sat on the mat. It ate a fish!"), (2, None), (3, " \n "), (4, "word " * 130)]
    got = {r["k"]: r["phrases"] for r in phrases.phrased(spark.createDataFrame(texts, "k int, text string"), tagging.Tagger()).collect()}
    assert got[2] is None and got[3] == [] and " ".join(got[4]).split() == ["word"] * 130
    assert " ".join(got[1]).split() == texts[0][1].split() and "the mat." in got[1] and "a fish!" in got[1]


class Logged:
    """Notes when each batch was asked, and fails for some prompts the first time."""

    def __init__(self, path):
        self.path = path

    def complete(self, prompts):
        import os
        import uuid

        with open(os.path.join(self.path, uuid.uuid4().hex), "w") as out:
            out.write(f"{time.time()} {len(prompts)}")
        seen = [os.path.join(self.path, "." + p) for p in prompts]
        out = [p.upper() if not p.endswith("7") or os.path.exists(s) else None for p, s in zip(prompts, seen)]
        for s in seen:
            open(s, "w").close()
        return out


def test_no_minute_has_more_requests_than_the_limit(spark, tmp_path):
    minute, limit = 0.5, 10
    rows = spark.range(100).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), "id")
    got = generation.paced(rows, Logged(str(tmp_path)), limit=limit, minute=minute, partitions=8).collect()
    assert {(r["id"], r["answer"]) for r in got} == {(i, f"P{i}") for i in range(100)} and len(got) == 100
    asked = sorted(tuple(map(float, f.read_text().split())) for f in tmp_path.iterdir() if not f.name.startswith("."))
    assert sum(n for _, n in asked) == 110
    for at, _ in asked:
        assert sum(n for t, n in asked if at <= t < at + minute) <= limit


def test_bins_are_even_and_results_those_of_plain_execution(spark):
    r = np.random.default_rng(5)
    costs = [float(x) for x in r.pareto(1.2, 2000) + 0.01]
    costs[0] = max(sum(costs) / 12, costs[0])
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "k int, cost double")
    out = generation.balanced(rows, "k", "cost", 8).select("k", "cost", "bin", F.spark_partition_id().alias("p")).collect()
    assert sorted(x["k"] for x in out) == list(range(2000)) and all(x["p"] == x["bin"] for x in out)
    loads = [sum(x["cost"] for x in out if x["bin"] == b) for b in range(8)]
    assert max(loads) <= 1.2 * max(sum(loads) / 8, max(costs) / 1.2)
    assert generation.balanced(rows.limit(0), "k", "cost", 3).count() == 0
    same = spark.createDataFrame([(i, 1.0) for i in range(50)], "k int, cost double")
    counts = [x["count"] for x in generation.balanced(same, "k", "cost", 5).groupBy("bin").count().collect()]
    assert sum(counts) == 50 and max(counts) <= 12
    programs = spark.createDataFrame([(i, f"assert {i} % 3", 1.0 + i) for i in range(9)], "k int, program string, cost double")
    plain = {(x["k"], x["passed"]) for x in generation.executed(programs).collect()}
    assert {(x["k"], x["passed"]) for x in generation.executed(generation.balanced(programs, "k", "cost", 3)).collect()} == plain
