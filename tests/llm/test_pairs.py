import random
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradus.llm import graph, op4_lines, op7_jaccard

from .fixtures import DOCS, documents


def sets(text, words):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, words, percent):
    own = [(i, sets(t, words)) for i, t in rows if i is not None]
    root = {i: i for i, _ in own}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(own, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {i: top(i) for i in root}


def near_copies(n, seed):
    """Groups of near copies, a passage that many share, and others."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefg", k=r.randint(2, 6)))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(r.randint(20, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = r.random()
        w = list(r.choice(base)) if kind < 0.6 else [word() for _ in range(r.randint(1, 60))] + passage if kind < 0.8 else [word() for _ in range(r.randint(1, 80))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows


def shrunk(monkeypatch):
    """Bounds that make small inputs take the paths of large ones: shuffles, hot keys, contraction by pivots."""
    for name, value in (("BROADCAST_ROWS", 10), ("HOT", 30), ("CONTRACTED", 2), ("PIVOTS", 2), ("TURNS", 2), ("FINISH_EDGES", 40), ("CELL_ROWS", 8)):
        monkeypatch.setattr(graph, name, value)


@pytest.mark.parametrize("words,percent,large", [(3, 90, False), (5, 80, True)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, words, percent, large):
    monkeypatch.setattr(op7_jaccard, "COMMON", 6)
    monkeypatch.setattr(op7_jaccard, "BLOCK", 5)
    monkeypatch.setattr(op7_jaccard, "COLUMNS", 64)
    if large:
        shrunk(monkeypatch)
    rows = near_copies(160, words)
    got = op7_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, words, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(sets(t, words)) for i, t in rows}


def test_a_passage_that_hundreds_of_unlike_texts_share(spark, monkeypatch):
    shrunk(monkeypatch)
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, passage + " " + " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(300)]
    got = op7_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == brute(rows, 3, 90)


def test_frequent_values_are_all_found(spark):
    n = 300_000
    value = F.when(F.col("id") % 3 == 0, -7).when(F.col("id") % 3 == 1, F.col("id") % 700).otherwise(F.xxhash64("id"))
    rows = spark.range(n).select(value.alias("g"))
    often = {r["g"] for r in rows.groupBy("g").count().where(f"count * {graph.HOT} > {n}").collect()}
    found = op7_jaccard.frequent(rows, "g")
    assert often <= set(found) and len(found) == len(set(found)) < 2 * graph.HOT
    assert op7_jaccard.frequent(rows.where("g IS NULL"), "g") == []


def test_hot_shingles_are_the_last_of_any_set(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(60)]
    docs = documents(spark, [(i, f"{' '.join(f'p{j}' for j in range(12))} {t}", "en", "a", 0) for i, t in enumerate(own)])
    reps = op7_jaccard.sets(docs, 3, 90)
    low = {r["v"]: set(r["low"]) for r in op7_jaccard.rarest(docs, reps, reps, 3, 90).collect()}
    assert len(low) == 60 and all(not a & b for a, b in combinations(low.values(), 2))


def test_joins_in_two_threads_keep_their_own_tables(spark):
    tables = [near_copies(40, seed) for seed in (8, 9)]
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda rows: op7_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect(), tables))
    for rows, got in zip(tables, found):
        assert {x["doc_id"]: x["component_id"] for x in got} == brute(rows, 3, 90)


def test_jaccard_join_takes_awkward_rows(spark):
    got = op7_jaccard.join(documents(spark), 3, 90).collect()
    want = brute([(i, t) for i, t, *_ in DOCS], 3, 90)
    assert len(got) == len(DOCS)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert op7_jaccard.join(documents(spark, DOCS[:0]), 3, 90).count() == 0


def test_components(spark, monkeypatch):
    r = random.Random(5)
    ids = [r.getrandbits(60) for _ in range(150)]
    edges = [(ids[i], ids[i + 1]) for i in range(60)] + [(r.choice(ids[70:]), r.choice(ids[70:])) for _ in range(60)]
    want = {}
    for bound in (10, 500_000):
        monkeypatch.setattr(graph, "FINISH_EDGES", bound)
        got = {x["v"]: x["c"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = want or got
        assert got == want
    for a, b in edges:
        assert a == b or want[a] == want[b]
    assert all(want[c] == c <= v for v, c in want.items())
    assert len({want[i] for i in ids[:61]}) == 1


def test_edit_distance():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(0)
    for _ in range(3000):
        a = "".join(r.choices("abc", k=r.randint(0, 12)))
        b = "".join(c for c in a if r.random() > 0.1) + r.choice(("", "a", "bc"))
        for most in (1, 2, 3):
            assert op4_lines.edit_distance(a, b, most) == min(full(a, b), most + 1)
    pairs = []
    for _ in range(3000):
        a = "".join(r.choices("abcé\U0001f600", k=r.choice((0, 3, 12, 70, 130))))
        b = "".join(r.choice(("", "x", c + "a")) if r.random() < r.choice((0.0, 0.05, 0.2)) else c for c in a)
        pairs.append((a, b, r.choice((1, 2, 3, 9, 30, 31, 40))))
    assert op4_lines.within(pairs) == [full(a, b) <= most for a, b, most in pairs]
    assert op4_lines.within([]) == []


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(graph, "HOT", 4)
    rows = [(7, i) for i in range(50)] + [(i, i) for i in range(20)] + [(None, 1)]
    big, small = spark.createDataFrame(rows, "k long, x long"), spark.createDataFrame([(k, 10 * k, 51 if k == 7 else 1) for k in range(0, 20, 7)], "k long, y long, n long")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "k", how).collect()))
        assert want == sorted(map(str, graph.attached(big, small, "k", how).collect())) == sorted(map(str, graph.attached(big, small, "k", how, size="n").collect()))


@pytest.mark.parametrize("large", [False, True])
def test_line_dedup_equals_brute_force(spark, monkeypatch, large):
    if large:
        shrunk(monkeypatch)
        monkeypatch.setattr(op4_lines, "BLOCK", 4)
        monkeypatch.setattr(op4_lines, "GATHERED", 100)
    r = random.Random(2)
    base = ["".join(r.choices("abcde ", k=r.randint(24, 50))).strip().ljust(24, "x") for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 4)):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                line[r.randrange(len(line))] = r.choice("abcde")
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    place = [(line.strip(" "), i, p) for i, t in rows for p, line in enumerate(t.split("\n")) if len(line.strip(" ")) >= op4_lines.LEAST]
    root = list(range(len(place)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(place)), 2):
        if op4_lines.edit_distance(place[a][0], place[b][0], 2) <= 2:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    drop = {(place[k][1], place[k][2]) for k in range(len(place)) if top(k) != k}
    want = {i: "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in drop) for i, t in rows}
    got = op4_lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["text"] for x in got} == want


def test_line_threshold_grows_with_the_line(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    base = [" ".join(word() for _ in range(n)) for n in (10, 12, 25, 60, 150, 400)]
    base += [f"{word()} {word()} {base[3]} {' '.join(word() for _ in range(20))}"]  # holds another line
    lines = []
    for _ in range(150):
        line = list(r.choice(base))
        for _ in range(r.randint(0, len(line) // 60)):
            k = r.randrange(len(line))
            line[k : k + r.randint(0, 1)] = r.choice(("", "x", "yz"))
        lines.append("".join(line).strip(" "))
    root = list(range(len(lines)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(lines)), 2):
        most = max(2, min(len(lines[a]), len(lines[b])) // 50)
        if op4_lines.edit_distance(lines[a], lines[b], most) <= most:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = op4_lines.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got if x["text"]} == {k for k in range(len(lines)) if top(k) == k}
    text = " ".join([*(word() for _ in range(30)), "qrstuv", *(word() for _ in range(30))])
    assert len(text) >= 300
    got = op4_lines.dedup(spark.createDataFrame([(1, text), (2, text.replace("qrstuv", "klmnop"))], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["text"]) for x in got) == [(1, text), (2, "")]


def test_line_dedup_takes_awkward_rows(spark):
    got = op4_lines.dedup(documents(spark)).collect()
    text = {x["doc_id"]: x["text"] for x in got}
    assert len(got) == len(DOCS)
    assert text[1] == DOCS[0][1] and text[2] == "short" and text[3] == "" and text[4] is None and text[6] == DOCS[5][1]
    assert text[None] == DOCS[10][1]
    assert op4_lines.dedup(documents(spark, DOCS[:0])).count() == 0


def test_rows_that_share_a_doc_id_keep_their_own_lines(spark):
    rows = [(1, "same line"), (9, "same line"), (9, "wholly unique line"), (9, "same line\nanother line"), (9, "another line\nlast"), (9, "wholly unique line")]
    got = op4_lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), exact=1).collect()
    text = sorted((x["doc_id"], x["text"]) for x in got)
    lines = [line for _, t in text for line in t.split("\n") if line]
    assert len(got) == len(rows) and (1, "same line") in text
    # The two equal rows are one document repeated; every other line is there once.
    assert sorted(lines) == ["another line", "last", "same line", "wholly unique line", "wholly unique line"]


def test_grams_of_near_lines_meet():
    """Two lines within the threshold share a posted key, whatever is crowded."""
    r = random.Random(11)
    for n in (150, 151, 200, 420, 1500):
        for text in ("".join(r.choices("abcdefghij ", k=n)), ("ab" * n)[:n], "x" * n):
            other = list(text)
            for _ in range(int(op4_lines.allowed(n, 2)) - 1):
                k = r.randrange(len(other))
                other[k : k + r.randint(0, 1)] = r.choice(("", "q", "r"))
            other = "".join(other)
            if len(other) < 150:
                other += "z" * (150 - len(other))
            for crowded in (np.zeros(0, np.uint64), np.sort(op4_lines.hashed_grams([text])[2][::2])):
                row, key = op4_lines.grams([text, "y" * 160, other], 2, crowded)
                assert set(key[row == 0]) & set(key[row == 2])


def test_short_lines_lose_their_exact_copies(spark, tmp_path):
    rows = [(1, "Les.\nAll rights reserved.\n\n\t\nx"), (2, " Les. \nLes!\n\n\t"), (3, "x"), (4, "All rights reserved.\nnew")]
    want = {1: rows[0][1], 2: "Les!\n\n\t", 3: "", 4: "new"}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op4_lines.op4(spark, f"file://{tmp_path}").collect()
    assert {x["doc_id"]: x["text"] for x in got} == want
    docs = spark.createDataFrame([(*r, "en", "a", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert {x["doc_id"]: x["text"] for x in got} == {k: t for k, t in want.items() if t}
