"""Hand-worked cases: NULLs, ties, one-sided categories, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil import functions as C
from tabveil.operators import aggregates, cells, codes, distances, encoders, filters, joins, neighbours, privacy, ranking, sampling, utility
from tabveil.sources import tables


def col(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_functions(spark):
    assert [col(spark, v, C.clean_sentinels) for v in (" TAG", "?", "-1", "x", None)] == [None, None, None, "x", None]
    assert [col(spark, v, lambda c: C.year_bin(c.cast("date"))) for v in ("2000-05-01", "2001-01-01", None)] == [1995, 2000, None]
    assert [col(spark, v, lambda c: C.span_bin(c.cast("double"))) for v in ("5", "5.1", "0", "-2", "196")] == [0, 5, None, None, None]
    assert col(spark, "(5, 10]", C.bin_left_edge) == 5.0 and col(spark, "x", C.bin_left_edge) is None
    assert col(spark, "1800-01-03", C.date_to_days) == 2.0 and col(spark, "no", C.date_to_days) is None
    x = spark.createDataFrame([(-3.0,), (0.5,)], "v double").withColumn("lo", F.lit(-3.0))
    assert [round(r[0], 9) for r in x.select(C.shifted_exp(C.shifted_log(F.col("v"), F.col("lo")), F.col("lo"))).collect()] == [-3.0, 0.5]


def test_constraints_and_null(spark):
    df = spark.createDataFrame([(1, 17), (2, None), (3, 40), (4, 95)], "id int, age int")
    rules = ["age >= 18", "NOT age > 90"]
    assert [r.id for r in filters.constrain(df, rules).collect()] == [3]
    assert sorted(r.id for r in filters.constrain(df, rules, lenient=True).collect()) == [2, 3]
    assert {r.rule: r.dropped for r in filters.constraint_report(df, rules).collect()} == {"age >= 18": 2, "NOT age > 90": 1}


def test_cells_and_copies(spark):
    df = spark.createDataFrame([(p, c) for p, c in [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None)]], "person int, place string")
    assert sorted((r.person, r.place) for r in filters.drop_small_cells(df, ["place"], "person", 2).collect() if r.place) == [(1, "a"), (2, "a"), (2, "a")]
    assert filters.drop_small_cells(df, ["place"], "person", 9).count() == 1
    assert [tuple(r) for r in filters.drop_all_repeated(df).orderBy("person").collect()] == [(1, "a"), (4, None)]
    other = spark.createDataFrame([(4, None), (1, "z")], "person int, place string")
    assert (4, None) not in {tuple(r) for r in filters.drop_leaks(df, other).collect()}
    assert filters.drop_leaks(df.limit(0), other).count() == 0


def test_numbers_and_running_sums(spark):
    df = spark.createDataFrame([(g, float(v), 1) for g in "ab" for v in range(50)], "g string, v double, n long")
    got = {(r.g, r.v): (r.n_upto, r.previous) for r in codes.running(df, "g", "v", ["n"], 7).collect()}
    assert all(got[g, v] == (v + 1, v - 1 if v else None) for g in "ab" for v in range(50))
    assert sorted(r.k for r in codes.numbered(df, [F.desc("v"), F.col("g")], "k", 5).collect()) == list(range(100))
    assert {r.value: r.code for r in codes.category_codes(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string"), "x").collect()} == {"a": 0, "b": 1}


def test_visits(spark):
    rows = [(1, "2020-01-01", 1, 10.0), (1, None, 2, 11.0), (2, "2020-01-01", 3, None), (2, "2020-01-02", 4, 5.0)] + [(3, f"2020-01-{d:02d}", 10 + d, float(d)) for d in range(1, 8)]
    df = spark.createDataFrame(rows, "person int, day string, row int, bp double").withColumn("sex", F.when(F.col("row") != 3, F.lit("m")))
    got = {r.person: r for r in aggregates.visit_history(df, "person", "day", "row", ["bp"], ["sex"]).collect()}
    assert [got[1][f"bp_{i}"] for i in range(1, 6)] == [None, None, None, 10.0, 11.0]
    assert got[2].sex == "m" and got[3].n_events == 7 and [got[3][f"bp_{i}"] for i in range(1, 6)] == [3.0, 4.0, 5.0, 6.0, 7.0]


def test_distances_of_small_pairs(spark):
    real = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), (None, 9.0)], "cat string, num double")
    fake = spark.createDataFrame([("a", 1.0), ("c", 4.0)], "cat string, num double")
    value = lambda d: d.first()["value"]
    assert value(distances.kl_discrete(real, fake, ["cat"])) == math.inf
    assert value(distances.total_variation(real, fake, ["cat"])) == pytest.approx(0.5)
    assert value(distances.dwp_discrete(real, fake, ["cat"])) == pytest.approx((abs(2 / 3 - 1 / 2) + 1 / 3) / 2 / math.sqrt(2))
    assert value(distances.kolmogorov_smirnov(real.where("cat is not null"), fake, ["num"])) == pytest.approx(0.5)
    same = distances.wasserstein(real, real, ["num"])
    assert value(same) == 0.0
    assert {(r.column, r.value): (r.n, r.m) for r in joins.paired_shares(real, fake, ["cat"]).collect()} == {("cat", "a"): (2, 1), ("cat", "b"): (1, 0), ("cat", "c"): (0, 1)}


def test_neighbours_on_a_grid(spark, monkeypatch):
    monkeypatch.setattr(cells, "LEFT_BLOCK", 5)
    monkeypatch.setattr(cells, "RIGHT_BLOCK", 4)
    grid = spark.createDataFrame([(i * 4 + j, float(i), float(j)) for i in range(4) for j in range(4)] + [(99, None, 0.0)], "id int, x double, y double")
    got = {(r.id, r["rank"]): (r.other, r.distance) for r in neighbours.k_nearest(grid, grid, ["x", "y"], 2, "l1", exclude_self=True).collect()}
    assert got[0, 1] == (1, 1.0) and got[0, 2] == (4, 1.0) and len(got) == 32


def test_privacy_by_hand(spark):
    df = spark.createDataFrame([("x", 1, "p"), ("x", 1, "q"), ("y", 2, "p"), ("y", 2, "p"), ("y", 2, "p")], "k1 string, k2 int, s string")
    assert privacy.k_anonymity(df, ["k1", "k2"]).first().k == 2 and privacy.l_diversity(df, ["k1", "k2"], "s").first().l == 1
    assert privacy.attribution(df, df, ["k1"], "s").first().cap == pytest.approx(1 - (0.5 + 0.5 + 3) / 5)
    assert privacy.attribution(df, df.where("k1 = 'z'"), ["k1"], "s").first().cap == 1.0
    assert privacy.k_anonymity(df.limit(0), ["k1"]).first().k is None
    scored = spark.createDataFrame([(True, 2.0), (True, 1.0), (False, 1.0), (False, 0.0)], "y boolean, s double")
    assert privacy.rank_auc(scored, F.col("y"), "s").first().auc == pytest.approx(0.875)


def test_ranks_and_ties(spark):
    df = spark.createDataFrame([("d", m, v) for m, v in (("a", 1.0), ("b", 2.0), ("c", 2.0), ("e", 5.0))], "dataset string, model string, value double")
    assert {r.model: r["rank"] for r in ranking.average_rank(df, ["dataset"], "value").collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "e": 4.0}
    assert ranking.critical_difference(4, 1) / math.sqrt(20 / 6) == pytest.approx(2.569, abs=2e-3)
    assert ranking.critical_difference(2, 1) / math.sqrt(1) == pytest.approx(1.960, abs=2e-3)
    x = spark.createDataFrame([(float("nan"), "higher"), (1.0, "lower"), (None, "lower")], "v double, d string")
    assert [r[0] for r in x.select(ranking.oriented(F.col("v"), F.col("d"))).collect()] == [-1e10, -1.0, -1e10]


def test_round_trips(spark):
    df = spark.createDataFrame([(1, "2020-02-03", 5.0, "m", "no"), (2, None, None, "f", "yes"), (3, "1999-12-31", 7.5, None, None)], "id int, day string, bmi double, sex string, smoker string").withColumn("day", F.col("day").cast("date"))
    p = encoders.Pipeline([("date", encoders.DateEncoder(["day"])), ("missing", encoders.MissingEncoder(["sex"], ["bmi", "day"], key="id", noise=0.05)), ("binary", encoders.BinaryEncoder(["smoker"])), ("labels", encoders.LabelEncoder(["sex"])), ("scale", encoders.Scaler(["bmi"]))]).fit(df)
    back = p.inverse(p.transform(df)).select(df.columns).orderBy("id").collect()
    assert [(r.id, r.day, r.bmi and round(r.bmi, 6), r.sex, r.smoker) for r in back] == [tuple(r) for r in df.orderBy("id").collect()]
    with pytest.raises(ValueError):
        encoders.BinaryEncoder(["sex"]).fit(spark.createDataFrame([("a",), ("b",)], "sex string"))


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 3, "rare").otherwise("common"))
    parts = {(r.g, r.part): r["count"] for r in sampling.stratified_split(df, ["id"], "g").groupBy("g", "part").count().collect()}
    assert parts == {("rare", "train"): 2, ("rare", "test"): 1, ("common", "train"): 797, ("common", "test"): 200}
    small = sampling.covering_sample(df, "id", ["g"], 10)
    assert small.count() == 10 and small.select("g").distinct().count() == 2
    s = sampling.nested_samples(df, ["id"], [5, 50, 5000])
    assert {r.sample_rows: r["count"] for r in s.groupBy("sample_rows").count().collect()} == {5: 5, 50: 50, 5000: 1000}


def test_scores_by_hand(spark):
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2)], "y int, g int, n long")
    r = utility.classification_scores(counts).first()
    assert r.balanced_accuracy == pytest.approx((0.75 + 1) / 2) and r.precision == pytest.approx(4 / 6 * 1 + 2 / 6 * 2 / 3)


def test_checks(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tables.check_spec(df, tables.Spec(["a"], target="b", constraints=["a < b"], delta=0.5)) == []
    assert len(tables.check_spec(df, tables.Spec(["z"], target="y", task="rank", constraints=["a <<< b"], delta=1.0))) == 5


def test_quantiles_of_uneven_groups(spark):
    """A value with most rows, NULL keys and values, a group of one row and one without known values."""
    import numpy as np

    rows = [("hot", 3.0)] * 900 + [("hot", float(v)) for v in range(-50, 40)] + [(None, float(v * v)) for v in range(7)] + [("one", 2.5), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = [0.0, 0.05, 0.3, 0.5, 1.0]
    got = {r.k: r.q for r in codes.quantiles(df, ["k"], "v", shares, cells=16).select("_g.k", "q").collect()}
    assert set(got) == {"hot", None, "one"}
    for k, q in got.items():
        assert q == pytest.approx(list(np.quantile([v for a, v in rows if a == k and v is not None], shares)))
    assert codes.quantiles(df.limit(0), [], "v", shares).collect() == []


def test_top_up_goes_on_to_valid_rows_at_the_end(spark):
    df = spark.range(2000).select("id", (F.col("id") >= 1950).alias("ok"))
    take = lambda n, **o: [(r.id, r.shortfall) for r in filters.top_up(df, ["ok"], n, [F.col("id")], **o).orderBy("id").collect()]
    assert take(20) == [(i, 0) for i in range(1950, 1970)]
    assert take(60) == [(i, 10) for i in range(1950, 2000)]
    assert take(5, tries=3) == [] and filters.top_up(df.limit(0), ["ok"], 5, [F.col("id")]).collect() == []


def test_top_up_reaches_the_end_of_a_long_table(spark):
    df = spark.range(20_000, numPartitions=8).select("id", (F.col("id") >= 19_996).alias("ok"))
    assert [tuple(r) for r in filters.top_up(df, ["ok"], 5, [F.col("id")]).select("id", "shortfall").orderBy("id").collect()] == [(i, 1) for i in range(19_996, 20_000)]


def test_attribution_of_the_nearest_key(spark):
    real = spark.createDataFrame([("x|y", "z", "s")], "a string, b string, secret string")
    fake = spark.createDataFrame([("x", "y|z", "s"), ("x|y", "q", "t"), ("x|y", "r", "s"), ("w", "z", "s"), ("w", "z", "s")], real.schema)
    assert privacy.generalised_attribution(real, fake, ["a", "b"], "secret").first().cap == pytest.approx(1 - 3 / 4)
    rows = [(None, "z", "s"), ("", "z", "t"), ("n", None, "s"), ("n", None, "s"), ("m", "m", None)]
    real, fake = (spark.createDataFrame(r, "a string, b string, secret string") for r in (rows, [(None, "z", "s"), ("", "q", "t"), ("n", None, "u"), ("n", None, "s"), ("k", "k", "s")]))
    # a NULL meets only NULL; "" only ""; the last row meets nothing and so all five
    near = [1.0, 1 / 2, 1 / 2, 1 / 2, 0.0]
    assert privacy.generalised_attribution(real, fake, ["a", "b"], "secret").first().cap == pytest.approx(1 - sum(near) / 5)
    assert privacy.generalised_attribution(real, fake.limit(0), ["a", "b"], "secret").first().cap is None


def test_samples_in_one_scan_equal_samples_one_by_one(spark):
    from tabveil.operators import replicates

    r = __import__("random").Random(5)
    make = lambda n: spark.createDataFrame([(i, r.choice("aab"), r.choice(["u", "v", None]), r.random(), None if i % 9 == 0 else r.random()) for i in range(n)], "id long, c string, d string, x double, y double")
    real, fake = make(120), make(300)
    samples = replicates.replicate_lists(fake, "id", 6, 0.1).cache()
    got = {x.sample: x for x in replicates.sample_scores(real, samples, 6, ["c", "d"], ["x", "y"]).collect()}
    for i in range(6):
        one = samples.where(F.array_contains("reps", i))
        assert got[i].value == pytest.approx(distances.sample_score(real, one, ["c", "d"], ["x", "y"]).first().value)
        assert got[i].covered == all(x.covered for x in filters.class_coverage(real, one, ["c", "d"]).collect())
    assert samples.select(F.explode("reps")).count() == pytest.approx(6 * 30, rel=0.5)
    plan = replicates.sample_scores(real, replicates.replicate_lists(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("o_orderkey AS id", "o_orderstatus AS c", "o_orderpriority AS d", "o_totalprice AS x", "o_custkey AS y"), "id", 500, 0.1), 500, ["c", "d"], ["x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("500") < 20 and plan.count("Union") == 0


def test_unknown_values_are_left_out_by_row_or_by_column(spark):
    real = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", None), (None, 4.0)], "cat string, num double")
    fake = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, None)], "cat string, num double")
    value = lambda d, c: {r.column: r.value for r in d.collect()}[c]
    by_row = distances.chi2_proportion(real.withColumn("other", F.col("num")), fake.withColumn("other", F.col("num")), ["cat", "other"])
    assert value(by_row, "cat") == pytest.approx(1.0)  # only the first row is known: shares 1 and 0 against 1/2 and 1/2
    assert value(distances.chi2_proportion(real.select("cat", "num"), fake, ["cat", "num"], nulls="columnwise"), "cat") == pytest.approx(2 * (2 / 3 - 1 / 2) ** 2 / 0.5)
    assert value(distances.kolmogorov_smirnov(real, fake, ["num"], nulls="columnwise"), "num") == pytest.approx(0.5)
    with pytest.raises(ValueError):
        distances.kl_normal(real, fake, ["num"], nulls="none")


def test_chi2_of_counts(spark):
    real = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10, "cat string")
    fake = spark.createDataFrame([("a",)] * 2 + [("b",)] * 2, "cat string")
    r = distances.chi2_counts(real, fake, ["cat"]).first()
    assert (r.statistic, r.degrees) == (pytest.approx(10.0), 1) and r.contingency == pytest.approx(math.sqrt(10 / 50))
    lacking = distances.chi2_counts(real, fake.where("cat = 'a'"), ["cat"]).first()
    assert lacking.statistic == math.inf and lacking.contingency == 1
    assert distances.chi2_counts(real.limit(0), fake.limit(0), ["cat"]).collect() == []


def test_swapped_scores(spark):
    counts = spark.createDataFrame([(0.0, 0.0, 6), (0.0, 1.0, 2), (1.0, 1.0, 3)], "y double, g double, n long")
    plain, swapped = utility.classification_scores(counts).first(), utility.classification_scores(counts, swapped=True).first()
    assert plain.balanced_accuracy == pytest.approx((6 / 8 + 1) / 2) and swapped.balanced_accuracy == pytest.approx((1 + 3 / 5) / 2)


def test_samples_are_summed_up_without_a_row_for_each(spark):
    from tabveil.operators import replicates

    r = np.random.default_rng(3)
    rows = [(i, None if i % 9 == 0 else "ab"[i % 2], float(r.normal(1e6)), None if i % 7 == 0 else float(r.normal())) for i in range(300)]
    df = replicates.replicate_lists(spark.createDataFrame(rows, "id long, c string, x double, y double").repartition(3), "id", 6, 0.4)
    reps = {x.id: x.reps for x in df.collect()}
    told = replicates.statistics(df, ["c"], ["x", "y"])
    assert "Generate" not in told._jdf.queryExecution().toString()
    got = {(x.rep, x.column, x.value): (x.n, list(x.r), list(x.varies)) for x in told.collect()}
    for k in range(6):
        mine = [v for v in rows if k in reps[v[0]]]
        n, (corr,), varies = got[k, None, None]
        assert n == len(mine) and varies == [1, 1]
        assert corr == pytest.approx(np.corrcoef(*np.array([v[2:] for v in mine if v[3] is not None]).T)[0, 1], rel=1e-9)
        assert {v: got[k, "c", v][0] for v in "ab"} == {v: sum(m[1] == v for m in mine) for v in "ab"}
