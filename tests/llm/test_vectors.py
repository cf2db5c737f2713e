import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import op2_topk, op6_permutation, vectors

RNG = np.random.default_rng(4)


def table(spark, n=600, d=16):
    x = RNG.normal(size=(n, d))
    x[: n // 3] = x[0] + 0.01 * RNG.normal(size=(n // 3, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows[7] = (7, rows[6][1])
    odd = [(n, None), (n + 1, []), (n + 2, [None] * d), (n + 3, [float("nan")] * d), (n + 4, [float("inf")] + [0.0] * (d - 1)), (n + 5, [1.0, 2.0]), (None, [1.0] * d), (n + 20, [0.0] * d), (3, rows[3][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "1 AS score", "2 AS d")
    return df, rows


def test_exact_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "INDEX_BLOCK", 50)
    monkeypatch.setattr(vectors, "TASK_ROWS", 200)
    monkeypatch.setattr(op2_topk, "STEP", 16)
    df, rows = table(spark)
    whole = vectors.valid(df).withColumn("v", F.transform("v", lambda x: F.floor(x * 256.0).cast("double")))
    got = {}
    for r in op2_topk.top_k(whole, 50, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    every = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows] + [(3, np.floor(np.array(rows[3][1]) * 256).astype(np.int64)), (620, np.zeros(16, np.int64))]
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    for q, found in got.items():
        own = dict(rows)[q]
        own = np.floor(np.array(own) * 256).astype(np.int64)
        best = sorted(((-int(own @ v), i) for i, v in every if i != q))[:5]
        assert [(i, s) for _, i, s in sorted(found)] == [(i, -s) for s, i in best]


def test_components_and_scores_beyond_64_bits(spark):
    """Finite components of any size: floors and scores are the nearest 64-bit integers, ties to the smaller vec_id."""
    rows = [(0, [1e20, 1e20]), (1, [1e20, -1e20]), (2, [1e20, 1.0]), (50, [-1e20, 1e18]), (3, [2.0**31, 0.5]), (4, [2.0**33, 2.0**33]), (100, [3e38, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = vectors.valid(df).withColumn("v", F.transform("v", lambda x: F.floor(x * 256.0).cast("double")))
    ints = {i: [int(max(-(2**63), min(float(2**63), np.floor(c * 256)))) for c in v] for i, v in rows}
    got = {}
    for r in op2_topk.top_k(whole, 50, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 50, 100):
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], v)))), i) for i, v in ints.items() if i != q)[:3]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in scored]


def test_permutation_index_recall(spark):
    df, rows = table(spark, 3000)
    got = {}
    for r in op6_permutation.neighbours(vectors.valid(df), 20, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([v for _, v in rows])
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        hits += len({i for _, i, _ in found} & set(best.tolist()))
        assert [v for _, _, v in sorted(found)] == sorted((v for _, _, v in found), reverse=True)
        assert all(abs(v - float(x[i] @ x[q])) < 1e-9 for _, i, v in found)
    assert len(got) == 150 and hits / (20 * len(got)) >= 0.9


def test_each_length_is_searched_among_its_own(spark):
    r = np.random.default_rng(9)
    rows = [(20 * i, r.normal(size=3 + i % 3).tolist()) for i in range(90)]
    df = vectors.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for x in op6_permutation.neighbours(df, 20, 4).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    exact = {}
    for x in op2_topk.top_k(df.withColumn("v", F.transform("v", lambda c: F.floor(c * 256.0).cast("double"))), 100, 4).collect():
        exact.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    for q, v in rows:
        mates = [(i, w) for i, w in rows if i != q and len(w) == len(v)]
        best = sorted((-float(np.dot(v, w)), i) for i, w in mates)[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in best]
        if q % 100 == 0:
            floors = [(i, np.floor(np.array(w) * 256)) for i, w in mates]
            best = sorted((-int(np.floor(np.array(v) * 256) @ w), i) for i, w in floors)[:4]
            assert [i for _, i in sorted(exact[q])] == [i for _, i in best]
    assert set(exact) == {q for q, _ in rows if q % 100 == 0}


def test_bounds_hold_and_eliminate():
    r = np.random.default_rng(5)
    x = np.floor(256 * r.normal(size=(4000, 32)) / 6)
    pivots = op2_topk.spread(x[:500], 24)
    span = op2_topk.Pivots(pivots)
    y, rest = span.placed((x * x).sum(axis=1), op2_topk.distances(x, pivots))
    upper = y[:50] @ y.T + rest[:50, None] * rest[None, :] + 1e-6 * ((x[:50] ** 2).sum(axis=1)[:, None] + (x * x).sum(axis=1) + 1)
    assert (upper >= x[:50] @ x.T).all()
    # No bound of the triangle inequality is below these.
    d = op2_topk.distances(x, pivots)
    triangle = np.abs(d[:50, None, :] - d[None, :, :]).max(axis=2)
    both = (x[:50] ** 2).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :]
    assert (upper <= (both - triangle**2) / 2 + 2e-6 * (both + 1)).all()
    index = pa.table({"vec_id": np.arange(4000), "row": np.arange(4000), "v": list(x), "x": list(d)})
    search = op2_topk.Search(index.slice(0, 50).combine_chunks(), pivots, x[:500], np.arange(500), 5)
    search.meet(index.combine_chunks())
    assert search.evaluated < 0.2 * 50 * 4000


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0] if i else [1.0, 1.0]) for i in range(0, 400, 20)]
    df = vectors.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["rank"], r["vec_id"]) for r in op6_permutation.neighbours(df, 20, 5).collect() if r["query_id"] == 100)
    assert [i for _, i in got] == [0, 20, 40, 60, 80]


def test_inverted_file_equals_footrule():
    r = np.random.default_rng(2)
    pivots = r.normal(size=(40, 6))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    x = r.normal(size=(300, 6))
    near, asked = op6_permutation.orders(x, pivots, 5), op6_permutation.orders(x[:1], pivots, 12)[0]
    shared = op6_permutation.InvertedFile(near, 40, 12).shared(asked, 12, 300)
    for i in range(300):
        a, b = ({p: k for k, p in enumerate(o.tolist())} for o in (near[i], asked))
        footrule = sum(abs(a.get(p, 12) - b.get(p, 12)) for p in range(40))
        assert footrule == sum(12 - k for k in a.values()) + sum(12 - k for k in b.values()) - 2 * shared[i]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op2_topk.top_k(vectors.valid(none), 50, 5).count() == 0
    assert op6_permutation.neighbours(vectors.valid(none), 20, 20).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_fewer_candidates_than_asked_for(spark, n):
    few = spark.createDataFrame([(20 * i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    assert op6_permutation.neighbours(vectors.valid(few), 20, 20).count() == n * (n - 1)


def test_large_components_are_exact():
    x = np.array([[3e8, 1.0], [2e8, 5.0]])
    assert op2_topk.scores(x, np.array([3e8, 7.0])).tolist() == [90000000000000007, 60000000000000035]
