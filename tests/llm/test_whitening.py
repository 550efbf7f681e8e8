import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, most=32):
    """(n, deviations, whitened, explained) by an eigendecomposition of the covariance, with exact whole numbers."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    whole = n * x - s
    y = whole / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    return n, [sum(v * v for v in row) for row in whole.tolist()], y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(rows, keys, vectors, most=32):
    n, deviation, white, explained = plain(vectors, most)
    k = white.shape[1]
    rows = sorted(rows, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in keys for c in range(1, k + 1)]
    w = np.array([r.whitened for r in rows]).reshape(-1, k)
    sign = np.sign((w * white).sum(axis=0))
    np.testing.assert_allclose(w * sign, white, atol=1e-8)
    np.testing.assert_allclose([r.explained for r in rows[:k]], explained, rtol=1e-9)
    assert [r.deviation for r in rows[::k]] == deviation and {r.n for r in rows} == {n}
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_equals_an_eigendecomposition(spark, small):
    data = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect())
    got = whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()
    check(got, [i for i, _ in data], [v for _, v in data])


def test_blocks_are_reduced_in_levels(spark, monkeypatch):
    """Many tasks, of which several are empty, and triangles reduced two at a time."""
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartitionByRange(12, "vec_id")
    check(whitening.whiten(df).collect(), range(60), vectors)
    check(whitening.whiten(df, most=2).collect(), range(60), vectors, 2)


def test_rows_that_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.2], [1.0, -3.0], [2.5, 0.0], [0.1, 0.2]]
    bad = [None, [], [nan, 1.0], [1.0, None], [inf, 0.0], [0.0, -inf], [1.0], [1.0, 2.0, 3.0], [1e30, 0.0]]
    df = spark.createDataFrame([*enumerate(good), *((100 + i, v) for i, v in enumerate(bad))], SCHEMA).repartition(3)
    check(whitening.whiten(df.withColumns({"k": F.lit(1), "v": F.lit(2), "n": F.lit(3)})).collect(), range(4), good)
    double = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    check(whitening.whiten(double).collect(), range(4), good)


def test_directions_without_variance_are_no_components(spark):
    flat = [[float(i), float(2 * i), 5.0] for i in range(8)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(flat)), SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 8
    for few in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 3):
        assert whitening.whiten(spark.createDataFrame(list(enumerate(few)), SCHEMA)).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    vectors = [[float(i % 7), 3e7 * (i == 0)] for i in range(200)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).collect()
    exact = plain(vectors)[1]
    assert exact[0] >= 1 << 63 > exact[1]
    assert {r.vec_id: r.deviation for r in got} == {i: x if x < 1 << 63 else None for i, x in enumerate(exact)}


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_jacobi(d):
    """Small singular values come out to full relative accuracy where columns are scaled, which an eigendecomposition of R'R loses."""
    rng = np.random.default_rng(d)
    r = np.linalg.qr(rng.normal(size=(200, d)), mode="r")
    sigma, v = whitening.jacobi(r)
    np.testing.assert_allclose(sigma, np.linalg.svd(r, compute_uv=False), rtol=1e-12)
    np.testing.assert_allclose(v.T @ v, np.eye(d), atol=1e-13)
    np.testing.assert_allclose(np.linalg.norm(r @ v, axis=0), sigma, rtol=1e-12)
    graded = r * 10.0 ** -np.linspace(0, 12, d)
    sigma, v = whitening.jacobi(graded)
    off = (graded @ v).T @ (graded @ v) / np.outer(sigma, sigma) - np.eye(d)
    assert np.abs(off).max() < 1e-12 and (np.diff(sigma) <= 0).all()
