"""Kernel densities against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.operators import cells, densities


def direct(points, data):
    data, points = np.array(data), np.array(points)
    n, d = data.shape
    cov = np.atleast_2d(np.cov(data.T)) * n ** (-2 / (d + 4))
    diff = points[:, None, :] - data
    power = np.einsum("abi,ij,abj->ab", diff, np.linalg.inv(cov), diff)
    return np.exp(-power / 2).mean(axis=1) / np.sqrt(np.linalg.det(2 * np.pi * cov))


def table(spark, x, at=0):
    return spark.createDataFrame([(at + i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"c{n} double" for n in range(len(x[0]))))


@pytest.mark.parametrize("width", [1, 3])
@pytest.mark.parametrize("tolerance", [1e-9, 1e-2])
def test_densities_equal_direct_sums(spark, monkeypatch, width, tolerance):
    monkeypatch.setattr(cells, "LEAF_ROWS", 12)
    r = np.random.default_rng(width)
    data = np.concatenate([r.normal(0, 1, (300, width)), r.normal(9, 0.2, (200, width)), np.full((60, width), 4.0)])
    points = np.concatenate([r.normal(2, 4, (80, width)), np.full((1, width), 300.0)])
    columns = [f"c{n}" for n in range(width)]
    got = {x.id: x.density for x in densities.kernel_density(table(spark, points, 5000), table(spark, data), columns, tolerance=tolerance).collect()}
    want = direct(points, data)
    assert len(got) == len(points)
    for i, v in enumerate(want):
        assert got[5000 + i] == pytest.approx(v, rel=max(tolerance, 1e-8), abs=1e-290)


@pytest.mark.parametrize("width", [1, 2])
def test_sums_by_series_meet_no_rows_and_outliers_do(spark, monkeypatch, width):
    r = np.random.default_rng(8 + width)
    data = np.concatenate([r.uniform(-3, 3, (3000, width)), np.full((500, width), 1.0)])
    near, far = r.uniform(-3, 3, (200, width)), np.array([[40.0] * width, [-9.0] * width])
    asked, meet = [], cells.meet
    monkeypatch.setattr(cells, "meet", lambda q, *a, **k: asked.append(q.select("id").distinct().count()) or meet(q, *a, **k))
    columns = [f"c{n}" for n in range(width)]
    get = lambda points: [v for _, v in sorted((x.id, x.density) for x in densities.kernel_density(table(spark, points), table(spark, data), columns).collect())]
    assert get(near) == pytest.approx(direct(near, data).tolist(), rel=1e-9) and asked == []
    both = np.concatenate([near, far])
    assert get(both) == pytest.approx(direct(both, data).tolist(), rel=1e-8, abs=1e-290) and max(asked, default=0) <= len(far)
    monkeypatch.setattr(densities, "NUMBERS", densities.POWERS**width)  # a grid too large for the driver: all by cells
    assert get(both) == pytest.approx(direct(both, data).tolist(), rel=1e-8, abs=1e-290) and asked


def test_singular_tables_are_refused_and_nulls_left_out(spark):
    r = np.random.default_rng(3)
    df = table(spark, r.normal(size=(50, 2)))
    with pytest.raises(np.linalg.LinAlgError):
        densities.kernel_density(df, df.withColumn("c1", F.lit(1.0)), ["c0", "c1"])
    holes = df.withColumn("c1", F.when(F.col("id") >= 40, None).otherwise(F.col("c1")))
    got = {x.id: x.density for x in densities.kernel_density(holes, holes, ["c0", "c1"]).collect()}
    x = np.array([tuple(v)[1:] for v in df.where("id < 40").orderBy("id").collect()])
    assert sorted(got) == list(range(40)) and [got[i] for i in range(40)] == pytest.approx(direct(x, x).tolist())


def test_members_that_were_copied_are_found(spark):
    r = np.random.default_rng(4)
    make = lambda n, at: table(spark, r.normal(size=(n, 2)), at)
    train, hold = make(200, 0), make(200, 1000)
    near = train.select((F.col("id") + 5000).alias("id"), *[(F.col(c) * 1.001).alias(c) for c in ("c0", "c1")])
    for mode in ("kde", "prior"):
        x = densities.density_membership(train, hold, near, ["c0", "c1"], mode, disjoint=True).first()
        assert x.auc > 0.5 and 0 <= x.accuracy <= 1
    with pytest.raises(ValueError):
        densities.density_membership(train, hold, near, ["c0", "c1"], "other")


def test_counts_within_a_radius_meet_few_rows(spark, monkeypatch):
    from tabveil.operators import cells, privacy

    r = np.random.default_rng(6)
    table = lambda v: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v)], "id long, a double, b double")
    near, far = np.round(r.normal(size=(60, 2)) * 50), np.round(r.normal(size=(4000, 2)) * 50)
    asked, meet = [], cells.meet
    monkeypatch.setattr(cells, "meet", lambda q, *a, **k: asked.append(q.count()) or meet(q, *a, **k))
    monkeypatch.setattr(cells, "LEAF_ROWS", 16)
    points = table(near).unionByName(spark.createDataFrame([(60, None, 0.0)], "id long, a double, b double"))
    got = dict(privacy.kernel_membership(points, table(far), ["a", "b"], 75.0).collect())
    assert got == {60: 0, **{i: int((np.sqrt(((far - p) ** 2).sum(axis=1)) <= 75).sum()) for i, p in enumerate(near)}}
    assert asked and asked[0] < 60 * 256 / 2  # most of the 256 cells lie inside or outside
    assert {r.density for r in privacy.kernel_membership(points, table(far).limit(0), ["a", "b"], 75.0).collect()} == {0}
