import numpy as np
from pyspark.sql import functions as F

from tabveil.llm import knn


def brute(rows, k):
    out = {}
    for q, v in rows:
        if q % 5 == 0:
            out[q] = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
    return {(q, n + 1, i, -s) for q, x in out.items() for n, (s, i) in enumerate(x)}


def test_against_brute_force_with_ties_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "DATA_BLOCK", 40)
    r = np.random.default_rng(1)
    centres = r.integers(-200, 200, (4, 8))
    rows = [(i, (centres[i % 4] + r.integers(-20, 20, 8)).tolist()) for i in range(300)] + [(i, centres[0].tolist()) for i in range(300, 420)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>").withColumn("score", F.lit("x"))
    got = {tuple(x) for x in knn.top_k(df, F.col("vec_id") % 5 == 0, k=5, n_pivots=6).collect()}
    assert got == brute(rows, 5)


def test_bad_vectors_few_rows_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    raw = spark.createDataFrame([(0, [0.5, -0.001]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0])], "vec_id long, embedding array<float>")
    v = knn.integer_vectors(raw)
    assert {(r.vec_id, tuple(r.vec)) for r in v.collect()} == {(0, (128, -1)), (1, (256, 256))}
    assert [tuple(r) for r in knn.top_k(v, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 128 * 256 - 256)]
    assert knn.top_k(v.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_groups_are_kept_apart_only_where_that_saves_copies():
    n = np.full(20, 60)
    assert knn.meet_all(np.full(20, 1.0), n).all() and knn.meet_all(np.full(20, 0.9), n).all()
    assert not knn.meet_all(np.full(20, 0.01), n).any()
    n = np.array([300] * 3 + [1000] * 17)
    assert knn.meet_all(np.array([1.0, 0.9, 0.8] + [0.01] * 17), n).tolist() == [True] * 3 + [False] * 17


def test_far_clusters_are_pruned_and_repeated_ids_count(spark, monkeypatch):
    """Vectors along few directions: most go to few groups. One query's id has several rows."""
    copied = []
    whole = knn.meet_all
    monkeypatch.setattr(knn, "meet_all", lambda share, n: copied.append(float(share.mean())) or whole(share, n))
    r = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 8] * 200 + r.integers(-5, 5, 8)).astype(int).tolist()) for i in range(600)] + [(10, [0, 0, 200, 0, 0, 0, 0, 0])] * 9
    got = {tuple(x) for x in knn.top_k(spark.createDataFrame(rows, "vec_id long, vec array<long>"), F.col("vec_id") % 5 == 0, k=5, n_pivots=8).collect()}
    assert {x for x in got if x[0] != 10} == {x for x in brute(rows, 5) if x[0] != 10}
    assert len([x for x in got if x[0] == 10]) == 5 and copied[0] < 0.3
