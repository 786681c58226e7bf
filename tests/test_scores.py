"""Normal scores, support curves and imputation votes against plain computations."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.functions import normal_cdf, normal_quantile
from tabveil.operators import distances, ranking
from tabveil.operators.encoders import MarginalNormal, QuantileNormal, normal_distances


def test_normal_functions(spark):
    p = [1e-7, 1e-4, 0.03, 0.0749, 0.076, 0.3, 0.5, 0.93, 1 - 1e-7, 1e-30]
    df = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0]], "p double")
    got = [tuple(r) for r in df.select(normal_quantile(F.col("p")).alias("z")).select("z", normal_cdf(F.col("z"))).collect()]
    assert [r[0] for r in got] == [pytest.approx(NormalDist().inv_cdf(x), rel=1e-12, abs=1e-15) for x in p] + [None, None]
    assert [r[1] for r in got[:-2]] == [pytest.approx(x, abs=8e-8) for x in p]


def test_the_marginal_that_fits_is_chosen_and_goes_back(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(r.normal(5, 3)), float(r.exponential()), 2.0, None if i % 5 == 0 else float(r.integers(0, 3))) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, bell double, tail double, flat double, few double")
    told = {x.column: x.distance for x in normal_distances(df, ["bell", "tail", "flat", "few"]).collect()}
    bell = sorted(x[1] for x in rows)
    fit = NormalDist(np.mean(bell), np.std(bell))
    assert told["bell"] == pytest.approx(max(max(abs((i + 1) / 900 - fit.cdf(v)), abs(i / 900 - fit.cdf(v))) for i, v in enumerate(bell)), abs=2e-7)
    assert told["bell"] < 0.05 < told["tail"] and told["flat"] == 1.0
    e = MarginalNormal(["bell", "tail", "flat", "few"]).fit(df)
    assert set(e.moments) == {"bell"} and set(e.empirical.columns) == {"tail", "flat", "few"}
    z = e.transform(df)
    back = {x.id: x for x in e.inverse(z).collect()}
    for i, *v in rows:
        assert [back[i][c] for c in ("bell", "tail", "flat", "few")] == [pytest.approx(x, abs=1e-4) if x is not None else None for x in v]
    tail = [x[2] for x in rows]
    assert {min(tail), max(tail)} <= {x.tail for x in back.values()}
    assert set(MarginalNormal(["bell"], fixed={"bell": "empirical"}).fit(df).empirical.columns) == {"bell"}
    assert normal_distances(df.limit(0), ["bell"]).collect() == []


def test_support_curves(spark):
    r = np.random.default_rng(2)
    real, fake = r.normal(size=(150, 2)), r.normal(0.3, 0.8, size=(120, 2))
    table = lambda x: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    norm = lambda x: np.sqrt((x**2).sum(axis=-1))
    alphas = np.linspace(0, 1, 7)
    pairs = norm(real[:, None] - fake)
    own = norm(real[:, None] - real) + np.where(np.eye(150), np.inf, 0)
    near = norm(fake[pairs.argmin(axis=1)] - fake.mean(axis=0))
    covered = pairs.min(axis=1) <= own.min(axis=1)
    precision = [(norm(fake - real.mean(axis=0)) <= q).mean() for q in np.quantile(norm(real - real.mean(axis=0)), alphas)]
    recall = [(covered & (near <= q * (1 + 1e-12))).mean() for q in np.quantile(near, alphas)]
    curves = distances.support_curves(table(real), table(fake), ["a", "b"], 7)
    got = sorted((x.alpha, x.precision, x.recall) for x in curves.collect())
    assert [x[1] for x in got] == pytest.approx(precision) and [x[2] for x in got] == pytest.approx(recall)
    score = distances.support_scores(curves).first()
    assert score.precision == pytest.approx(1 - np.abs(alphas - precision).sum() / alphas.sum())


def test_imputation_votes(spark):
    r = np.random.default_rng(3)
    truth = [(i, "abc"[r.integers(0, 3)]) for i in range(40)] + [(90, "a"), (91, None)]
    votes = [(i, "abcx"[min(3, r.integers(0, 5))] if r.random() < 0.5 else (t or "a")) for i, t in truth[:40] for _ in range(7)] + [(91, "a"), (3, None)]
    share = {(i, c): sum(v == c for j, v in votes if j == i) / max(1, sum(j == i for j, _ in votes)) for i, t in truth if t for c in "abc"}
    pos, neg = [s for (i, c), s in share.items() if dict(truth)[i] == c], [s for (i, c), s in share.items() if dict(truth)[i] != c]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    f1 = np.mean([max("abc", key=lambda c: (share[i, c], -ord(c))) == t for i, t in truth if t])
    got = distances.imputation_auc(spark.createDataFrame(votes, "row int, v string"), spark.createDataFrame(truth, "row int, v string"), "row", "v").first()
    assert (got.micro_f1, got.auc) == (pytest.approx(f1), pytest.approx(auc))


def test_what_is_clipped_goes_back_beside_the_ends(spark):
    v = [0.0, 1e-5, 2e-5, *map(float, range(1, 999)), 999.0 - 3e-5, 999.0 - 1e-5, 999.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(-1, None)], "id int, v double")
    e = QuantileNormal(["v"]).fit(df)
    e.edges["v"] = [float(i) for i in range(1000)]
    z = e.transform(df)
    got = dict(z.select("id", "v").collect())
    assert {round(got[i], 7) for i in (0, 1, 2)} == {round(NormalDist().inv_cdf(1e-7), 7)} and got[0] < got[1] < got[2] < got[3]
    back = dict(e.inverse(z).select("id", "v").collect())
    assert back.pop(-1) is None and back == pytest.approx(dict(enumerate(v)), abs=1e-4)
    assert back[0] == 0.0 and back[len(v) - 1] == 999.0 and all(0 < back[i] < 999 for i in back if 0 < i < len(v) - 1)


def test_friedman_of_tied_models_is_not_a_number(spark):
    make = lambda rows: spark.createDataFrame(rows, "block int, model string, value double")
    told = lambda rows: tuple(ranking.friedman(make(rows), ["block"]).first())
    assert str(told([(b, m, 0.05) for b in range(3) for m in "xyz"])) == "(3, 3, nan)"
    assert str(told([(b, "x", 0.05 * b) for b in range(3)])) == "(1, 3, nan)"
    assert told([]) == (0, 0, None)
    assert told([(b, m, float(v)) for b in range(3) for v, m in enumerate("xyz")]) == (3, 3, pytest.approx(6.0))
