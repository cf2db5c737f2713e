"""Work on rows is dealt over all cores, and what recurs is read once."""

import ast
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.functions import code, flow, syntax
from gradus.operators import generation, infill, similarity, tagging
from gradus.plans import bound, languages, sources
from gradus.session import TASKS

SF = "/root/testdata/sf0.001"


def dealt(rows):
    """Whether the rows, which one small file holds, are in as many tasks as the cores are worth, none with much more than its share."""
    sizes = rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    return len(sizes) >= TASKS * rows.sparkSession.sparkContext.defaultParallelism and max(sizes) <= 3 * sum(sizes) / len(sizes) + 3


@pytest.fixture
def read(monkeypatch):
    """Sources that were parsed, with nothing remembered before."""
    out, parsed = [], syntax.parsed
    monkeypatch.setattr(syntax, "parsed", lambda source, language: out.append(source) or parsed(source, language))
    flow._recent_flow.cache_clear()
    flow._recent_subtrees.cache_clear()
    return out


def test_b08_rows_are_dealt_and_recurring_sources_read_once(spark, read):
    assert dealt(languages.repeated(spark, SF).select("p_partkey", "reference", "hypothesis"))
    count, texts = flow.counters()[0], ["x = a; y = b;", "x = a;"]
    assert len({count(texts[1], [texts[0]] * 3, "java") for _ in range(5)}) == 1
    assert sorted(read) == sorted(texts)


def test_counts_of_matches_are_those_of_the_definition():
    for clipped in (False, True):
        count = flow.matched(lambda text, _: text.split(), list, clipped)
        for h, rs in (("a b a c", ["a a a b d", "c c"]), ("", ["a"]), ("a", []), ("b b", ["", "b b b"])):
            hits = total = 0
            for r in rs:
                other = h.split()
                for x in r.split():
                    total += 1
                    if x in other:
                        hits += 1
                        if clipped:
                            other.remove(x)
            assert count(h, rs, "java") == (hits, total)


def test_long_sources_are_not_kept(read):
    text = "x = a; " * flow.SHORT
    for _ in range(2):
        assert len(flow.subtrees(text, "java")) and len(flow.data_flow(text, "java"))
    assert len(read) == 4 and not flow._recent_flow.cache_info().currsize


def test_b09_rows_are_dealt_and_recurring_sources_read_once(spark, read):
    assert dealt(languages._flow_rows(spark, SF))
    assert len({languages._shown("let a = b;", x) for x in ("js", "javascript") * 5}) == 1
    assert len(read) == 1


def test_b11_renamed_rows_are_dealt_and_recurring_sources_read_once(spark, read):
    assert dealt(languages._renamed(spark, SF))
    for _ in range(5):
        a, b = (code.normalised_flow(flow.data_flow(x, "java")) for x in ("int a = c;", "int b = d;"))
        assert a == b and a
    assert len(read) == 2


def test_x02_edges_are_made_in_all_tasks(spark):
    rows = languages._edge_rows(spark, SF)
    assert rows.rdd.getNumPartitions() >= TASKS * spark.sparkContext.defaultParallelism and dealt(rows)


def test_t07_a_row_is_read_once(monkeypatch):
    asked, found = [], flow.data_flow
    monkeypatch.setattr(languages.flow, "data_flow", lambda source, language: asked.append(source) or found(source, language))
    assert languages._in_order("int a = b;", "java") == "True1" and len(asked) == 1


@pytest.mark.parametrize("language", ["php", "javascript", "c_sharp", "java", "go", "ruby"])
def test_b13_pairs_are_dealt(spark, language):
    pairs = languages.repeated(spark, SF).where(F.col("language") == language)
    assert dealt(pairs) and pairs.count() > TASKS


@pytest.mark.parametrize("name", ["f31_replaced_docstring", "f32_updated_docstring", "f34_hoisted_imports", "f05_instruction_and_examples", "f33_docstring_names", "a22_flow_match"])
def test_programs_are_dealt_before_they_are_parsed(spark, name):
    assert dealt(sources.entries()[name].run(spark, SF))


def test_f05_examples_compile_no_pattern_by_name(monkeypatch):
    monkeypatch.setattr(re, "_compile", lambda *_: pytest.fail("compiled"))
    for k in range(3):
        assert code.instruction_and_examples(f"Scale.\n>>> f{k}([1])\n2\n>>> g(1)\n3", f"f{k}") == ("Scale.\n>>> g(1)\n3".replace("\n", ""), f"    >>>f{k}([1])\n    2")


def test_b03_b04_words_of_few_rows_are_held_at_a_time():
    held, whole = [], pa.array([["a", "b"]] * 100)
    for n, _ in enumerate(similarity._rows(whole, whole)):
        held.append(n)
    assert held == list(range(100)) and similarity.TOGETHER < 100


def test_texts_decoded_together_have_the_paths_they_have_alone():
    r = np.random.default_rng(2)
    for _ in range(20):
        tagger = tagging.Tagger(r.integers(0, 3, (11, 10)).astype(float), r.integers(0, 3, (10, len(tagging.SHAPES))).astype(float))
        tagger.pairs, tagger.shapes = np.round(tagger.pairs), np.round(tagger.shapes)  # many ties
        own = [r.integers(0, len(tagging.SHAPES), r.integers(0, 40)) for _ in range(60)]
        got = dict(tagger.paths(own))
        assert sorted(got) == [k for k, s in enumerate(own) if len(s)] and all((tagger.path(own[k]) == p).all() for k, p in got.items())


@pytest.mark.parametrize("query", ["g04_new_tasks", "g05_verified"])
def test_tasks_are_written_once_and_by_all_cores(spark, monkeypatch, query):
    made, tasks = [], bound._tasks
    monkeypatch.setattr(bound, "_tasks", lambda s, d: made.append(tasks(s, d)) or made[-1])
    assert bound.entries()[query].run(spark, SF).count() and len(made) == 1
    assert len(made[0].inputFiles()) >= TASKS * spark.sparkContext.defaultParallelism


def test_e07_a_narrowed_model_scores_as_the_whole_one(spark):
    r = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    texts = spark.createDataFrame([(" ".join(r.choice(words, int(r.integers(0, 30)))),) for _ in range(60)] + [(None,), ("",)], "text string")
    asked = spark.createDataFrame([("w1", "w2", "w3"), ("w1", "w2", "none"), ("<s>", "w5", "w9"), ("w7", "</s>", "w0"), ("odd", "odder", "w1"), ("w1", "odd", None)], "u string, v string, w string")
    counted = infill.triples(texts)
    for few in (100, 0):
        less = infill.narrowed(counted, asked, few)
        got, want = (sorted(map(str, infill.scored(asked, infill.fit(x)).select("u", "v", "w", "p").collect())) for x in (less, counted))
        assert got == want and less.agg(F.sum("kinds")).first()[0] == counted.count() and less.count() < counted.count() / 2


def test_e07_triples_are_those_of_the_definition(spark):
    got = infill.triples(spark.createDataFrame([("A b\n a",), ("b",), ("b",), (" ",), (None,)], "text string"))
    assert sorted(map(tuple, got.collect())) == [("<s>", "a", "b", 1), ("<s>", "b", "</s>", 2), ("a", "b", "a", 1), ("b", "a", "</s>", 1)]


def test_g06_columns_beside_the_prompt_stay_as_they_came(spark, monkeypatch):
    """The prompts alone become Python values, a hundred at a time; nulls and lists beside them are not converted."""
    held, asked, made = spark.range(2).select("id", F.lit("p").alias("prompt")), [], []

    class Asked:
        def complete(self, prompts):
            asked.append(len(prompts))
            return [p.upper() for p in prompts]

    monkeypatch.setattr(type(held), "mapInArrow", lambda self, run, schema: made.append(run))
    generation.completed(held, Asked(), wait=0)
    batch = pa.RecordBatch.from_pydict({"n": [None, 1] * 125, "list": [[1]] * 250, "prompt": ["p"] * 250})
    (out,) = made[0](iter([batch]))
    assert asked == [100, 100, 50] and out["answer"].to_pylist() == ["P"] * 250
    assert out["n"].equals(batch["n"]) and out["list"].equals(batch["list"])


@pytest.mark.parametrize("name", ["hoisted_imports", "without_docstrings", "updated_docstring"])
def test_f32_f33_f34_look_at_statements_only(monkeypatch, name):
    source = 'def f(x):\n    """Add.\n    >>> f(1)\n    """\n    try:\n        import a\n    except E:\n        from b import c\n    return x\nclass K:\n    import d\n'
    monkeypatch.setattr(ast, "walk", lambda *_: pytest.fail("walked expressions"))
    monkeypatch.setattr(ast.NodeTransformer, "generic_visit", lambda *_: pytest.fail("visited expressions"))
    got = {"hoisted_imports": code.hoisted_imports, "without_docstrings": code.without_docstrings, "updated_docstring": lambda s: code.updated_docstring(s, "Sum.")}[name](source)
    want = {"hoisted_imports": "import a\nfrom b import c\nimport d\n\ndef f(x):", "without_docstrings": "'f': 'Add.", "updated_docstring": ">>> f(1)"}[name]
    assert want in (str(got[0]) if name == "without_docstrings" else got)


def test_f22_and_g14_rounds_read_texts_once(spark):
    read = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("the quick nation is running .",), (None,), ("",), ("a b  the",)], "text string").coalesce(1)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = tagging.fit(rows.mapInArrow(told, "text string"), rounds=3)
    assert read.value == 4
    again = tagging.fit(rows, rounds=3)
    assert np.array_equal(got.pairs, again.pairs) and np.array_equal(got.shapes, again.shapes)
