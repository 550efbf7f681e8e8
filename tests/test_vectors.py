import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import vectors


def frames(spark, rows):
    base = spark.createDataFrame(rows, "base_id long, vector array<double>")
    return base, base.withColumnRenamed("base_id", "query_id")


def plain(rows, asked, k):
    m = np.array([v for _, v in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norm > 0, norm, 1)
    out = {}
    for i, (own, _) in enumerate(rows):
        if own in asked:
            s = np.round(m @ m[i], vectors.DIGITS)
            out[own] = [b for _, b in sorted((-s[j], b) for j, (b, _) in enumerate(rows) if b != own)[:k]]
    return out


@pytest.mark.parametrize("lot", [7, 4096])
def test_equals_brute_force(spark, monkeypatch, lot):
    """Clusters of different width, copies, opposite vectors and zeros; small lots of base rows and of queries."""
    monkeypatch.setattr(vectors, "LOT", lot)
    monkeypatch.setattr(vectors, "QUERY_LOT", max(3, lot // 2))
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 5))
    rows = [(i, (middle[i % 6] + 0.02 * (i % 6) * rng.normal(size=5)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(30)] + [(400, [0.0] * 5), (401, [0.0] * 5), (402, (-middle[0]).tolist())]
    base, queries = frames(spark, rows)
    asked = {r for r, _ in rows if r % 4 == 0}
    queries = queries.filter(F.col("query_id") % 4 == 0)
    for cells in (1, 8):
        index = vectors.build_index(base, cells)
        got = {}
        for r in vectors.search(index, queries, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.base_id)
        assert got == plain(rows, asked, 5)
    assert vectors.pruned_share(index, queries, 5) > 0.4
    assert vectors.search(index, queries, 1).count() == len(asked)


def test_few_and_faulty_rows(spark):
    nan = float("nan")
    base, queries = frames(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0])])
    got = {(r.query_id, r.base_id) for r in vectors.top_k(queries, base, 5).collect()}
    assert got == {(1, 2), (2, 1)}
    assert vectors.top_k(queries, base.limit(0)).count() == 0 and vectors.top_k(queries.limit(0), base).count() == 0
    zeros, own = frames(spark, [(1, [0.0, 0.0]), (2, [0.0, 0.0])])
    assert {(r.query_id, r.base_id, r.score) for r in vectors.top_k(own, zeros).collect()} == {(1, 2, 0.0), (2, 1, 0.0)}


def test_a_query_goes_to_an_area_once(spark):
    """Cells share an area up to a lot, so that a query's vector is not repeated for each cell, and no batch holds more than a few rows."""
    rng = np.random.default_rng(5)
    base, queries = frames(spark, [(i, rng.normal(size=4).tolist()) for i in range(300)])
    index = vectors.build_index(base, 16)
    seen = vectors.visits(index, queries.filter("query_id < 50"), 5)
    assert len(index.cells) > 8 and seen.count() == seen.select("query_id").distinct().count() == 50
    assert seen.agg(F.max(F.size("cells"))).first()[0] > 1
    areas = vectors.Index(index.table, index.centres, {-1: (9, 0.0, 0.0), 0: (4000, 0.0, 1.0), 1: (90, 0.0, 1.0), 2: (7, 0.0, 1.0), 3: (9000, 0.0, 1.0), 4: (1, 0.0, 1.0)}).areas()
    assert areas == {-1: 0, 0: 1, 1: 1, 2: 2, 3: 3, 4: 4}


def test_nothing_is_collected(spark, small, monkeypatch):
    from pyspark.sql import classic

    def no(*_):
        raise AssertionError("rows at the driver")

    monkeypatch.setattr(classic.dataframe.DataFrame, "toLocalIterator", no)
    monkeypatch.setattr(classic.dataframe.DataFrame, "toPandas", no)
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    got = vectors.top_k(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("vector")), 3)
    assert got.count() == 3 * e.count()
