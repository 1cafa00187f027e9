import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import neighbours


def brute(rows, queries, k=10):
    out = {}
    for q in queries:
        near = {}
        for v, x in rows:
            if v != q:
                near[v] = min(near.get(v, 1e300), float(np.sqrt(((np.array(rows_of(rows, q), float) - np.array(x, float)) ** 2).sum())))
        out[q] = sorted((d, v) for v, d in near.items())[:k]
    return out


def rows_of(rows, q):
    return next(x for v, x in rows if v == q)


def test_recall_and_scores_on_the_test_table(spark):
    sf = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([v.embedding for v in vectors], np.float64)
    ids = np.array([v.vec_id for v in vectors])
    got = {}
    for r in neighbours.op3_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 100 == 0)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        assert sorted(found) == list(range(1, 11))
        assert all(abs(d[ids == v][0] - s) < 1e-9 for v, s in found.values())
        hits += len({v for v, _ in found.values()} & set(best.tolist()))
    assert hits >= 0.95 * 10 * len(got)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, [0.0, 1.0, 0.0]), (100, [5.0, 5.0, 5.0]), (3, [9.0, 9.0, 9.0])]
    bad = [(4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, []), (10, [1.0, 2.0]), (200, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, [0, 100])
    assert {q: [v for _, v in x] for q, x in got.items()} == {q: [v for _, v in x] for q, x in want.items()}
    assert neighbours.nearest(vectors.where("vec_id in (4, 5)"), F.lit(True)).count() == 0
    assert neighbours.nearest(vectors.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(vectors.where("vec_id = 0"), F.lit(True)).count() == 0


def test_blocks_of_queries_give_the_same(spark):
    r = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, r.normal(size=7).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, neighbours.nearest(vectors, F.col("vec_id") % 10 == 0).collect()))
    assert one == sorted(map(tuple, neighbours.nearest(vectors, F.col("vec_id") % 10 == 0, block=4).collect()))


def test_recall_where_a_third_of_the_vectors_are_near_copies(spark):
    r = np.random.default_rng(5)
    n, dim = 6000, 32
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::3] = x[0] + r.normal(size=(n // 3, dim)) * 0.002
    x = x.astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for row in neighbours.nearest(vectors, F.col("vec_id") % 250 == 0).collect():
        got.setdefault(row.query_id, {})[row.rank] = row.vec_id
    assert len(got) == n // 250
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert [found[k] for k in range(1, 11)] == np.lexsort((np.arange(n), d))[:10].tolist()


def test_recall_on_fifty_thousand_skewed_vectors(spark):
    r = np.random.default_rng(8)
    n, dim = 50_000, 16
    x = r.normal(size=(n, dim)) * np.exp(r.normal(size=(n, 1)))
    x[::3] = x[0] + r.normal(size=(len(x[::3]), dim)) * 0.01  # a third of them near copies
    x[1::30] = x[1]  # and some equal
    x = x.astype(np.float32)
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": x.tolist()})).repartition(4)
    got = {}
    for row in neighbours.nearest(vectors, F.col("vec_id") % 2500 == 0).collect():
        got.setdefault(row.query_id, {})[row.rank] = row.vec_id
    assert len(got) == n // 2500
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert [found[k] for k in range(1, 11)] == np.lexsort((np.arange(n), d))[:10].tolist()
