"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import op12_whitening, vectors

RNG = np.random.default_rng(12)


def brute(x, k):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, s, values, (x - s / n) @ axes / np.sqrt(values), values / (centred**2).sum() * n


@pytest.mark.parametrize("size", [3, 24, 80])
def test_equals_eigenvectors_of_the_whole_covariance(spark, size):
    x = RNG.normal(size=(400, size)) * np.linspace(2, 1, size)
    x[300:] = x[7]  # one vector holds a quarter of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'y' AS x", "1 AS n", "2 AS v")
    got = op12_whitening.whitened(op12_whitening.integers(df), 4).collect()
    k = min(4, size)
    ints = np.floor(x * 256)
    n, s, values, w, explained = brute(ints, k)
    assert len(got) == 400 * k and {r["n"] for r in got} == {n}
    for c in range(k):
        own = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        z = np.array([own[i]["whitened"] for i in range(400)])
        assert np.abs(np.abs(z) - np.abs(w[:, c])).max() < 1e-7 and abs(abs(z @ w[:, c]) / (w[:, c] @ w[:, c]) - 1) < 1e-9
        assert abs(own[0]["explained"] / explained[c] - 1) < 1e-9
    far = ((n * ints.astype(np.int64) - s.astype(np.int64)) ** 2).sum(axis=1)
    assert all(r["deviation"] == far[r["vec_id"]] and r["deviation_text"] == str(far[r["vec_id"]]) for r in got)
    assert {r["identity_error"] for r in got}.pop() < 1e-9


def test_iteration_certifies_close_eigenvalues():
    values = np.linspace(1, 0.5, 120)
    q = np.linalg.qr(RNG.normal(size=(120, 120)))[0]
    v = (q * values) @ q.T
    found, axes, passes = op12_whitening.eigenpairs(lambda b: v @ b, 120, 4)
    assert np.abs(found - values[:4]).max() < 1e-12 and np.abs(np.abs((q[:, :4] * axes).sum(axis=0)) - 1).max() < 1e-10
    assert 1 < passes < 200
    assert op12_whitening.eigenpairs(lambda b: b * 3.0, 50, 4)[0].tolist() == pytest.approx([3.0] * 4)
    assert np.abs(op12_whitening.eigenpairs(lambda b: b * 0.0, 50, 4)[0]).max() == 0
    low = np.diag([1e9, 1.0, 1e-3, *[0.0] * 60])
    assert op12_whitening.eigenpairs(lambda b: low @ b, 63, 4, block=8)[0][:3].tolist() == pytest.approx([1e9, 1.0, 1e-3])


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (6, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [-0.001, 1.0]), (8, [1.0]), (9, [2.0]), (10, [3.0, 3.0, 3.0]), (11, [1e20, -1e20, 1.0, 0.0]), (12, [0.0, 1.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = op12_whitening.whitened(op12_whitening.integers(df), 4).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {6: 4, None: 2, 7: 2, 8: 1, 9: 1, 10: 3, 11: 4, 12: 4}
    assert all(r["whitened"] is None and r["explained"] == 0 and r["n"] == 1 and r["identity_error"] == 0 for r in by[10])
    # The two short vectors: mean 384, deviations of 128 either way.
    assert sorted(r["whitened"] for i in (8, 9) for r in by[i]) == pytest.approx([-1.0, 1.0])
    assert by[8][0]["deviation"] == (2 * 256 - 768) ** 2
    # Three distinct vectors of length 2, all of whose second components are 256.
    second = [r for i in (6, 7, None) for r in by[i] if r["component"] == 2]
    assert all(r["whitened"] is None for r in second)
    # Components beyond 64 bits are the nearest integers; what leaves 64 bits is null, its digits are there.
    low, high = -(2**63), 2**63 - 1024
    n, own = 2, [high, low, 256, 0]
    other = [0, 256, 0, 1280]
    want = str(sum((n * a - (a + b)) ** 2 for a, b in zip(own, other)))
    assert {(r["deviation"], r["deviation_text"]) for r in by[11]} == {(None, want)}


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op12_whitening.whitened(op12_whitening.integers(df)).count() == 0
    one = op12_whitening.whitened(op12_whitening.integers(spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<float>"))).collect()
    assert [(r["component"], r["deviation"], r["whitened"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, 0, None), (2, 0, None)]


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    got = op12_whitening.op12(spark, sf).toPandas()
    e = vectors.valid(spark.read.parquet(f"{sf}/embeddings.parquet")).withColumn("v", F.transform("v", lambda c: F.floor(c * 256.0).cast("double"))).toPandas()
    x = np.stack(e["v"].values)
    n, _, _, w, explained = brute(x, 4)
    for c in range(4):
        own = got[got.component == c + 1].set_index("vec_id").loc[e.vec_id]
        assert np.abs(np.abs(own.whitened.values) - np.abs(w[:, c])).max() < 1e-9
        assert abs(own.explained.iloc[0] / explained[c] - 1) < 1e-9
    assert got.identity_error.max() < 1e-9 and set(got.n) == {n}
