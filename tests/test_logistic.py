"""Logistic models fitted together against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.operators import logistic as L


def alone(x, y, penalty=0.01):
    """Gradient descent on the same loss, for one model."""
    z = np.hstack([(x - x.mean(axis=0)) / np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), 1), np.ones((len(x), 1))])
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    b, pen = np.zeros(z.shape[1]), np.array([penalty] * x.shape[1] + [0.0])
    for _ in range(20000):
        b -= 0.5 * (z.T @ (w * (1 / (1 + np.exp(-z @ b)) - y)) + pen * b)
    return b


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(9)
    x = np.column_stack([r.normal(3, 2, 400), r.exponential(5, 400), np.full(400, 7.0)])
    y = (x[:, 0] - 0.3 * x[:, 1] + r.normal(size=400) > 1).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, i % 4, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, fold int, a double, b double, c double, y int").repartition(3)


def test_folds_equal_separate_fits(spark, data):
    x, y = data
    df = frame(spark, x, y)
    hole = df.withColumn("a", F.when(F.col("id") != 17, F.col("a"))).withColumn("y", F.when(F.col("id") != 18, F.col("y")))
    models = L.fold_logistics(hole, F.col("fold"), ["a", "b", "c"], "y", 4)
    rows = np.arange(400)
    for i in range(4):
        mine = (rows % 4 != i) & (rows != 17) & (rows != 18)
        assert models.coefficients[i] == pytest.approx(alone(x[mine], y[mine]), abs=1e-6)
    one = L.fit_logistics(df.withColumn("models", F.array(F.lit(0))), ["a", "b", "c"], "y", 1)
    p = {r.id: r.p[0] for r in one.probabilities(df, "p").collect()}
    b = alone(x, y)
    z = np.hstack([(x - x.mean(axis=0)) / np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), 1), np.ones((400, 1))])
    assert [p[i] for i in range(400)] == pytest.approx((1 / (1 + np.exp(-z @ b))).tolist(), abs=1e-6)


def test_cross_validation_and_bags(spark, data):
    x, y = data
    df = frame(spark, x, y).drop("fold")
    got = {r.metric: r.value for r in L.cross_validation(df, "id", ["a", "b"], "y", 3).collect()}
    assert {m.split("_")[0] for m in got} == {"fold0", "fold1", "fold2"} and all(v > 0.75 for m, v in got.items() if m.endswith("balanced_accuracy"))
    told = L.bagged(df, df, F.col("id") % 3, ["a", "b"], "y").collect()
    parts = [alone(x[np.arange(400) % 3 == i][:, :2], y[np.arange(400) % 3 == i]) for i in range(3)]
    scores = []
    for i, b in enumerate(parts):
        mine = x[np.arange(400) % 3 == i][:, :2]
        scores.append(1 / (1 + np.exp(-np.hstack([(x[:, :2] - mine.mean(axis=0)) / mine.std(axis=0, ddof=1), np.ones((400, 1))]) @ b)))
    assert {r.id: r.score for r in told} == {i: pytest.approx(v, abs=1e-6) for i, v in enumerate(np.mean(scores, axis=0))}


def test_no_rows_and_one_class(spark, data):
    df = frame(spark, *data)
    assert (L.fold_logistics(df.limit(0), F.col("fold"), ["a"], "y", 2).coefficients == 0).all()
    assert (L.fold_logistics(df.where("y = 1"), F.col("fold"), ["a"], "y", 2).coefficients == 0).all()
