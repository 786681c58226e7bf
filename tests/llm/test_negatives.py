import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.llm import negatives as N

SCHEMA = "vec_id long, label long, vec array<long>"


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    """rows of distinct ids."""
    out = set()
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, v in rows:
        if a % every == 0:
            scored = sorted((-product(v, w), i, other == label) for i, other, w in rows if i != a)
            for p, (s, i, _) in enumerate([x for x in scored if x[2]][:positives]):
                window = [(n, j) for n, j, same in scored if not same and low * -s <= 100 * -n <= high * -s]
                out |= {(a, i, r + 1, j, -s, -n, p + 1) for r, (n, j) in enumerate(window[:negatives])}
    return out


def mined(spark, rows, every):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "anchor_id": F.lit(1)}).repartition(3)
    got = N.hard_negatives(df, F.col("vec_id") % every == 0).collect()
    found = {tuple(r) for r in got}
    assert len(found) == len(got)
    return found


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SAMPLE": 40, "ANCHOR_BLOCK": 9, "DATA_BLOCK": 70, "STEP": 16, "SLICE": 3}.items():
        monkeypatch.setattr(N, name, value)


def test_against_brute_force_with_a_hot_label_ties_and_copies(spark, small):
    r = np.random.default_rng(2)
    centres = r.integers(-150, 150, (6, 10))
    rows = [(i, int(r.integers(0, 3)) if i % 3 else 7, (centres[i % 6] + r.integers(-40, 40, 10)).tolist()) for i in range(400)]
    rows += [(i, i % 2, centres[0].tolist()) for i in range(400, 460)]
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_windows_that_only_lowered_thresholds_fill(spark, small):
    """Few rows lie in a window, and near its end; zero and negative scores leave windows of one score or none."""
    r = np.random.default_rng(4)
    rows = [(i, 0, [100, 0, 0]) for i in range(0, 20)] + [(i, 1, [int(r.integers(40, 60)), 1, 0]) for i in range(20, 60)] + [(i, 2, [96 + i % 5, 0, 3]) for i in range(60, 200)]
    rows += [(205, 3, [0, 0, 0]), (206, 3, [0, 0, 0]), (210, 4, [-5, 0, 0]), (211, 4, [5, 0, 0]), (215, 5, [1, 1, 1])]
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_bad_rows_few_rows_short_vectors_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    raw = spark.createDataFrame([(0, [0.5, -0.001], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [None, 1.0], 1), (5, [inf, 0.0], 1), (6, [1.0, 0.0], None), (7, [], 2)], "vec_id long, embedding array<float>, label int")
    v = N.labelled_vectors(raw)
    assert {(r.vec_id, r.label, tuple(r.vec)) for r in v.collect()} == {(0, 1, (128, -1)), (1, 1, (256, 256)), (7, 2, ())}
    assert N.hard_negatives(v, F.col("vec_id") == 0).collect() == [] and N.hard_negatives(v.limit(0), F.col("vec_id") == 0).collect() == []
    short = [(0, 1, [10]), (1, 1, [10, 9]), (2, 2, [8]), (3, 2, [9, 1, 1]), (4, 2, [])]
    assert mined(spark, short, 50) == brute(short, 50) != set()


def test_repeated_ids(spark, small):
    rows = [(0, 1, [10, 0]), (0, 1, [10, 0]), (1, 1, [10, 1]), (1, 1, [10, 1]), (2, 2, [8, 0]), (2, 2, [8, 0]), (3, 2, [7, 0])]
    got = N.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.positive_rank, r.positive_id, r["rank"], r.negative_id, r.negative_score) for r in got) == [(p, 1, k + 1, i, s) for p in (1, 2) for k, (i, s) in enumerate([(2, 80), (2, 80), (3, 70)])]


def test_the_index_finds_all_pairs_above_the_thresholds_and_leaves_out_the_rest():
    r = np.random.default_rng(7)
    x = r.integers(-100, 100, (300, 20)).astype(float) / (1 + np.arange(20)) ** 2
    q = r.integers(-100, 100, (12, 20)).astype(float) / (1 + np.arange(20)) ** 2
    for least in (np.full(12, -np.inf), np.full(12, 4000.0), r.integers(-1000, 9000, 12).astype(float), np.full(12, np.inf)):
        i, j, score = N.reachable(x, q, least)
        whole = q @ x.T
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(12) for b in range(300) if whole[a, b] >= least[a]}
        assert np.allclose(score, whole[i, j])
    with pytest.raises(ValueError):
        N.meeting(1, np.arange(1), 1, False)(*[N.pa.table({"vec_id": [n], "label": [n], "vec": N.pa.array([[1 << 30]], N.pa.list_(N.pa.int64())), "low": [[0.0]], "high": [[1.0]]}) for n in (1, 2)])
