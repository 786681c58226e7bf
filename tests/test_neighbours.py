"""The pruned neighbour join and what stands on it, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.operators import cells, neighbours


def all_pairs(left, right, k, metric, exclude_self=False):
    out = {}
    for i, x in left:
        d = sorted((float(np.abs(np.subtract(x, y)).sum() if metric == "l1" else np.sqrt(((np.subtract(x, y)) ** 2).sum())), j) for j, y in right if not (exclude_self and i == j))
        for n, (v, j) in enumerate(d[:k]):
            out[i, n + 1] = (j, pytest.approx(v))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in rows], "id long, " + ", ".join(f"c{n} double" for n in range(len(rows[0][1]))))


@pytest.mark.parametrize("metric, k, width", [("l2", 2, 2), ("l1", 3, 3), ("l2", 20, 1)])
def test_pruned_join_equals_all_pairs(spark, monkeypatch, metric, k, width):
    """Clusters, a hot point, a column of few values, far outliers; blocks smaller than a cell."""
    for name, value in {"LEAF_ROWS": 16, "LEFT_BLOCK": 30, "RIGHT_BLOCK": 24}.items():
        monkeypatch.setattr(cells, name, value)
    r = np.random.default_rng(width)
    make = lambda n, at: [(at + i, np.round(r.normal(r.integers(0, 3), 0.3, width), 1 if i % 2 else 6).tolist()) for i in range(n)]
    left, right = make(120, 0) + [(900, [50.0] * width)], make(300, 1000) + [(2000 + i, [1.0] * width) for i in range(80)]
    columns = [f"c{n}" for n in range(width)]
    got = neighbours.k_nearest(table(spark, left), table(spark, right), columns, k, metric)
    assert {(r.id, r["rank"]): (r.other, r.distance) for r in got.collect()} == all_pairs(left, right, k, metric)
    both = left + [(i, x) for i, x in right[-90:]]
    got = neighbours.k_nearest(table(spark, both), table(spark, both), columns, k, metric, exclude_self=True)
    assert {(r.id, r["rank"]): (r.other, r.distance) for r in got.collect()} == all_pairs(both, both, k, metric, True)


def test_few_and_no_rows(spark):
    one = table(spark, [(1, [0.0, 0.0])])
    assert [tuple(r) for r in neighbours.k_nearest(one, one, ["c0", "c1"], 3).collect()] == [(1, 1, 1, 0.0)]
    assert neighbours.k_nearest(one, one, ["c0", "c1"], 3, exclude_self=True).collect() == []
    assert neighbours.k_nearest(one, one.limit(0), ["c0", "c1"], 1).collect() == [] and neighbours.k_nearest(one.limit(0), one, ["c0", "c1"], 1).collect() == []
    assert neighbours.k_nearest(one.withColumn("c1", F.lit(None).cast("double")), one, ["c0", "c1"], 1).collect() == []


def test_most_pairs_are_left_out(spark):
    r = np.random.default_rng(8)
    rows = table(spark, [(i, x.tolist()) for i, x in enumerate(r.normal(size=(8000, 2)))])
    x = neighbours.pairs_compared(rows.where("id < 2000"), rows.where("id >= 2000"), ["c0", "c1"], 2).first()
    assert x.pairs == 2000 * 6000 and x.compared < x.pairs / 5
