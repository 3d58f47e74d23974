"""The nearest-neighbour join by pivots against all pairs."""

import numpy as np
import pytest

from graphloom.operators import knn, vectors

SCHEMA = "vec_id long, embedding array<double>"


def rows_of(x, first=0):
    return [(first + i, [float(y) for y in v]) for i, v in enumerate(x)]


def brute(rows, queries, k):
    out = []
    held = [(i, np.array(v)) for i, v in rows]
    for q, v in queries:
        near = sorted((float(np.sqrt(((x - np.array(v)) ** 2).sum())), i) for i, x in held)[:k]
        out += [(q, i, r, round(d, 9)) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.vec_id, r.rank, round(r.distance, 9)) for r in df.collect())


def clustered(n, clusters=30, size=12, seed=0, spread=0.02):
    r = np.random.default_rng(seed)
    return r.normal(size=(clusters, size))[r.integers(0, clusters, n)] + r.normal(scale=spread, size=(n, size))


@pytest.mark.parametrize("k, sizes", [(1, {}), (5, {"block": 40, "meet": 7, "pivots": 9}), (90, {"block": 16, "pivots": 4})])
def test_knn_join(spark, k, sizes):
    x = np.concatenate([clustered(300), np.random.default_rng(1).normal(size=(60, 12)), np.ones((50, 12))])
    rows = rows_of(x)
    queries = rows[::13] + rows_of(np.random.default_rng(2).normal(size=(6, 12)) * 3, 1000)
    df, q = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(queries, SCHEMA)
    assert got(knn.knn_join(df, q, k, **sizes)) == brute(rows, queries, k)


def test_rows_that_take_no_part(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [1.0, 2.0, 3.0]), (6, [0.0, 1.0]), (None, [5.0, 5.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = knn.knn_join(df, df.where("vec_id in (1, 2, 5)"), 9)
    assert [(r.query_id, r.vec_id, r.rank) for r in out.orderBy("rank").collect()] == [(1, 1, 1), (1, 6, 2)]
    assert knn.knn_join(df.limit(0), df, 3).count() == 0 and knn.knn_join(df, df.limit(0), 3).count() == 0


def test_pairs_are_ruled_out(spark):
    """On vectors that cluster, a query is compared with a small share of the rows."""
    rows = rows_of(clustered(6000))
    df = spark.createDataFrame(rows, SCHEMA)
    join = knn.PivotJoin(df, df.where("vec_id % 20 = 0"), 5, block=128)
    said = join.compared().first()
    assert said.every == 6000 * 300 and 0 < said.n < 0.1 * said.every
    assert got(join.result()) == brute(rows, rows[::20], 5)


def test_many_queries_are_joined_by_pivots(spark):
    rows = rows_of(clustered(200))
    df = spark.createDataFrame(rows, SCHEMA)
    out = vectors.top_k_batch(df, df, 2, most_queries=50)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().toString()
    assert got(out) == brute(rows, rows, 2)


def test_k_nearest_sums_few_pairs_exactly(monkeypatch):
    """Estimates rule out all but few pairs; ties of copies go by place, and distances are sums in order."""
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 24))
    x[700:760] = x[10]  # copies, which tie
    points = np.concatenate([x[::50], x[10:11] + 1e-9])
    at, row, d = knn.k_nearest(x, points, 5)
    for i, p in enumerate(points):
        s = np.zeros(len(x))
        for j in range(24):
            s += (x[:, j] - p[j]) ** 2
        best = np.lexsort((np.arange(len(x)), np.sqrt(s)))[:5]
        assert row[at == i].tolist() == best.tolist() and d[at == i].tolist() == np.sqrt(s)[best].tolist()
    odd = np.array([[np.inf, 0.0], [np.nan, 0.0], [1e200, 0.0], [3.0, 0.0]])
    assert knn.k_nearest(odd, np.zeros((1, 2)), 4)[1].tolist() == [3, 0, 2, 1]
    assert len(knn.k_nearest(odd[:0], np.zeros((1, 2)), 4)[0]) == 0


def test_top_k_batch_takes_queries_to_all_rows_by_matrices(spark):
    """No expression is interpreted for each pair; null vectors rank last, null queries have the least keys."""
    rows = [(None, [0.5, 0.5]), (0, None), *rows_of(np.random.default_rng(4).normal(size=(40, 2)), 1), (41, [1.0]), (42, [1.0, None])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = vectors.top_k_batch(df, df.where("vec_id % 20 = 0"), 3)
    assert "zip_with" not in out._jdf.queryExecution().toString()
    sound = [x for x in rows[2:42]]
    assert got(out.where("query_id <> 0 and vec_id is not null")) == [x for x in brute(sound, [s for s in sound if s[0] % 20 == 0], 3)]
    assert [(r.vec_id, r.distance, r["rank"]) for r in out.where("query_id = 0").orderBy("rank").collect()] == [(0, None, 1), (1, None, 2), (2, None, 3)]
    few = spark.createDataFrame([(0, [0.0]), (1, None), (2, [5.0])], SCHEMA)
    for most in (4096, 0):
        assert [(r.vec_id, r["rank"]) for r in vectors.top_k_batch(few, few.where("vec_id = 0"), 3, most_queries=most).orderBy("rank").collect()] == [(0, 1), (2, 2), (1, 3)]
