"""Whitening against numpy's eigenvectors and exact whole numbers."""

import numpy as np
import pytest

from quillspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, key string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "k") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_jacobi():
    r = np.random.default_rng(1)
    for dim in (1, 2, 3, 7, 16):
        a = np.linalg.qr(r.normal(size=(3 * dim, dim)) * 10.0 ** r.integers(-3, 4, dim), mode="r")
        size, v = W.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(dim), atol=1e-13)
        assert size == pytest.approx(np.linalg.svd(a, compute_uv=False), rel=1e-10)
        assert np.allclose(np.linalg.norm(a @ v, axis=0), size)
    # Small values stay accurate beside large ones, where squares in a covariance matrix would lose them.
    a = np.diag([1e8, 1.0, 1e-7])
    assert W.jacobi(a)[0] == pytest.approx([1e8, 1.0, 1e-7], rel=1e-14)


def test_whiten(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(500, 12)) @ np.diag(np.linspace(0.05, 2, 12)) + 3
    df = W.whiten(table(spark, [*vectors, None, [], [None] * 12, [float("nan")] * 12, [float("inf")] * 12, [1.0] * 5]))
    rows = df.collect()
    x = np.floor(1024 * vectors.astype(np.float32).astype(float)).astype(np.int64) + W.SHIFT
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    want = centred @ v[:, :8] / np.sqrt(e[:8])
    assert len(rows) == 500 * 8
    got = {(q["vec_id"], q["component"]): q for q in rows}
    for k in range(8):
        mine = np.array([got[i, k + 1]["whitened"] for i in range(500)])
        assert np.allclose(mine * np.sign(mine @ want[:, k]), want[:, k], atol=1e-9)
        assert got[0, k + 1]["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
    for i in range(500):
        assert int(got[i, 1]["deviation"]) == sum(int(z) ** 2 for z in n * x[i] - s) and got[i, 1]["n"] == n
    w = np.array([[got[i, k]["whitened"] for k in range(1, 9)] for i in range(500)])
    assert got[0, 1]["identity_error"] == pytest.approx(np.abs(np.cov(w.T, bias=True) - np.eye(8)).max(), abs=1e-12) and got[0, 1]["identity_error"] < 1e-10


def test_edges(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [None, []])).count() == 0
    assert W.whiten(table(spark, [[1, 2]])).count() == 0
    assert W.whiten(table(spark, [[1, 2]] * 9)).count() == 0
    # One direction only, rows that repeat, one dimension.
    rows = W.whiten(table(spark, [[0, 5], [1, 5], [0, 5], [1, 5]])).collect()
    assert {q["component"] for q in rows} == {1} and sorted(round(q["whitened"], 9) for q in rows) == [-1, -1, 1, 1]
    assert W.whiten(table(spark, [[0], [1], [3]])).count() == 3
    # Of two lengths that are equally frequent the shorter one stays.
    assert {q["vec_id"] for q in W.whiten(table(spark, [[0, 1], [1, 0], [1, 2, 3], [3, 2, 1]])).collect()} == {0, 1}


def test_large_deviations():
    x = np.array([[2**20, 0]], np.int64)
    got = W._deviations(x, 2**20, np.array([0, 0], np.int64)).to_pylist()
    assert int(got[0]) == 2**80
