"""Language spans: the model against hand counts, Viterbi against all paths, predictions on held-out rows."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import op13_language

from . import fixtures

EN = "the quick brown fox jumps over the lazy dog while the other animals watch from the shade of a tree"
DE = "der schnelle braune fuchs springt über den faulen hund während die anderen tiere im schatten zuschauen"
RU = "быстрая коричневая лиса прыгает через ленивую собаку пока другие звери смотрят из тени дерева"
EL = "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί ενώ τα άλλα ζώα κοιτούν"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(EN, "en"), (DE, "de"), (RU, "ru"), (EL, "el"), (None, "en"), ("text without language", None), ("", "en")]
    return op13_language.fit(spark.createDataFrame(rows * 3, "text string, lang string").selectExpr("*", "'x' AS gram", "1 AS n"))


def label(model, *texts):
    return op13_language.Labeller(model).label(list(texts))


def test_spans_of_mixed_texts_tile_them(model):
    text = f"{EN}. {DE}! {RU}?"
    (lang, score, spans), = label(model, text)
    assert [s[2] for s in spans] == ["en", "de", "ru"] and lang in ("en", "de") and 0 < score < 1
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert text[spans[1][0] :].startswith("der ") and text[spans[2][0] :].startswith("быстрая")


def test_undetermined_and_other_scripts(model):
    got = label(model, None, "", "123 !?", "中文字", "́́", "a" * 100_000, "İx " + EN)
    assert [g[0] for g in got[:3]] == ["und"] * 3 and got[4][0] == "und" and all(g[1] == 0 for g in got[:3])
    assert got[3][0] in model.languages and got[3][1] <= 0.5  # no learned language has that script
    assert got[5][0] in ("de", "en") and got[6][0] == "en"
    assert op13_language.Labeller(op13_language.Model({}, {})).label(["word"]) == [("und", 0.0, [])]


def test_scripts_narrow_the_candidates(model):
    s = model.scores(["собака", "лиса", "hund", "από"])
    k = {x: i for i, x in enumerate(model.languages)}
    assert s[0].argmax() == s[1].argmax() == k["ru"] and s[2].argmax() == k["de"] and s[3].argmax() == k["el"]
    assert s[0][k["en"]] == -op13_language.CLIP and (s <= 0).all() and (s.max(axis=1) == 0).all()


def test_trigram_probabilities_sum_to_one_and_equal_counts_by_hand(spark):
    own = op13_language.fit(spark.createDataFrame([("ab ab aab", "x"), ("b", "y")], "text string, lang string"))
    k = own.languages.index("x")
    letters = [ord("a"), ord("b"), 3]

    def p(a, b, c):
        return math.exp(own.grams(np.array([a << 42 | b << 21 | c]))[0][k])

    rest = math.exp(own.floor)
    for a, b in ((2, 2), (2, ord("a")), (ord("a"), ord("b")), (ord("b"), ord("b"))):
        assert abs(sum(p(a, b, c) for c in letters) + rest - 1) < 1e-3
    # ab, ab, aab: after two starts always a (3 of 3, one kind); letters are a 4, b 3, end 3 of 10.
    one = (1 - op13_language.UNSEEN) * 4 / 10 + rest
    two = 3 / 4 + 1 / 4 * one
    assert abs(p(2, 2, ord("a")) - (3 / 4 + 1 / 4 * two)) < 1e-9


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(13)
    for n, k, switch in product((1, 2, 5, 7), (1, 2, 3), (1.0, 4.0)):
        for _ in range(20):
            s = -r.exponential(2.0, size=(n, k))
            s[np.arange(n), r.integers(0, k, n)] = 0.0

            def worth(path):
                return sum(s[i, x] for i, x in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

            best = max(worth(p) for p in product(range(k), repeat=n))
            assert abs(worth(op13_language.spans(s, switch).tolist()) - best) < 1e-9


def test_documents_with_awkward_rows(spark, model):
    docs = fixtures.documents(spark).selectExpr("*", "'x' AS lang_pred", "'y' AS spans")
    got = op13_language.labelled(docs, model).select("doc_id", "text", "language.*").collect()
    assert len(got) == len(fixtures.DOCS)
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert op13_language.labelled(docs.limit(0), model).count() == 0
    nothing = op13_language.fit(docs.limit(0))
    assert {r["language"]["lang"] for r in op13_language.labelled(docs, nothing).collect()} == {"und"}


def test_words_leave_the_cache(model, monkeypatch):
    monkeypatch.setattr(op13_language, "CACHE_WORDS", 5)
    held = op13_language.Labeller(model)
    assert [held.label([EN, DE, RU])[i][0] for i in range(3)] == ["en", "de", "ru"]
    assert [held.label([EN, DE, RU])[i][0] for i in range(3)] == ["en", "de", "ru"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op13_language.op13(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    own = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert own["n"] > 100 and own["right"] >= 0.98
    assert got.count() == truth.count()


def test_words_are_read_once_in_runs_that_hold_them_whole(model, monkeypatch):
    odd = ["ΟΔΟΣ ΟΔΟΣ, ΑΣ.ΑΣ ΣΑΣ", "İstanbul İx", "́́ x éa", "a b\x1cd\x85e​f", "中文字、中文", "y,z" * 40, "a'b-c_d9e ß ǅ x\x00y", "\ud800abc d"]
    for text in (*odd, " ".join(odd)):
        assert [w for run in op13_language.runs(text) for w in op13_language.words_of(run)] == op13_language._WORD.findall(text.lower())
    read = []
    words_of = op13_language.words_of
    monkeypatch.setattr(op13_language, "words_of", lambda run: read.append(run) or words_of(run))
    held = op13_language.Labeller(model)
    assert len({held.label([f"{EN}, {EN.upper()}! {EN}."])[0][:2] for _ in range(3)}) == 1
    assert len(read) == len(set(EN.split()))


def test_long_words_leave_the_table(model, monkeypatch):
    monkeypatch.setattr(op13_language, "CACHE_WORDS", 5)
    held = op13_language.Labeller(model)
    for k in range(20):
        held.label(["ab" * 40 + "c" * k])
        assert len(held.table) <= 6
