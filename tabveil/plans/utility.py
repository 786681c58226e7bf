"""Queries on models: from the size, tax and discount of a line item to whether it was returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.functions import unit_hash
from tabveil.operators import logistic as L
from tabveil.operators import utility as U
from tabveil.plans.distances import rounded
from tabveil.registry import query, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "days"]


def lines(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("key"), "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("days"), (F.col("l_returnflag") == "N").cast("int").alias("returned"))
    return x.where("l_orderkey % 10 >= 2 AND l_orderkey % 2 = 0"), x.where("l_orderkey % 10 >= 2 AND l_orderkey % 2 = 1"), x.where("l_orderkey % 10 < 2")


@query("m01_m02_utility")
def m01(spark, sf_dir):
    a, b, h = lines(spark, sf_dir)
    return rounded(U.utility(a, b, h, FEATURES, "returned", ["logistic", "elastic"]))


@query("m03_svm")
def m03(spark, sf_dir):
    a, b, h = lines(spark, sf_dir)
    return rounded(U.utility(a, b, h, FEATURES, "returned", ["svm"]))


@query("m04_forest")
def m04(spark, sf_dir):
    a, b, h = lines(spark, sf_dir)
    return rounded(U.utility(a, b, h, FEATURES, "returned", ["forest"]))


@query("m05_bagged")
def m05(spark, sf_dir):
    a, _, h = lines(spark, sf_dir)
    return rounded(U.classification_scores(U.confusion(L.bagged(a, h, F.floor(unit_hash(11, F.col("key")) * 3), FEATURES, "returned"))))


@query("m04_m06_regression")
def m04_regression(spark, sf_dir):
    a, b, h = lines(spark, sf_dir)
    return rounded(U.utility(a, b, h, ["l_quantity", "l_discount"], "l_extendedprice", ["forest_regression", "boosted_regression"]), 3)


@query("m06_boosted")
def m06(spark, sf_dir):
    a, b, h = lines(spark, sf_dir)
    return rounded(U.utility(a, b, h, FEATURES, "returned", ["boosted"], augment=True))


CONFUSION = "c AS (SELECT l_linenumber % 3 AS y, l_suppkey % 3 AS g, count(*) AS n FROM lineitem GROUP BY 1, 2)"
CLASSES = f"{CONFUSION}, k AS (SELECT y, sum(n) AS rows, sum(n) FILTER (WHERE y = g) AS hit FROM c GROUP BY 1), q AS (SELECT g AS y, sum(n) AS guessed FROM c GROUP BY 1), m AS (SELECT y, rows, rows / t AS share, hit / rows AS recall, hit / guessed AS precision, 2 * (hit / rows) * (hit / guessed) / (hit / rows + hit / guessed) AS f1, (t - rows - guessed + hit) / (t - rows) AS spec FROM k JOIN q USING (y), (SELECT sum(n) AS t FROM c))"


@query("m07_m12_scores", f"WITH {CLASSES} SELECT round(avg(recall), 6) AS balanced_accuracy, round(sum(share * precision), 6) AS precision, round(sum(share * recall), 6) AS recall, round(sum(share * f1), 6) AS f1, round(sum(share * sqrt(recall * spec)), 6) AS gmean, round(sum(f1 * (1 - share)) / (count(*) - 1), 6) AS inverse_f1 FROM m")
def m07(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("label"), (F.col("l_suppkey") % 3).alias("prediction"))
    return rounded(U.classification_scores(U.confusion(x)))


@query("m07_swapped_scores", f"WITH {CLASSES.replace('l_linenumber % 3 AS y, l_suppkey % 3 AS g', 'l_suppkey % 3 AS y, l_linenumber % 3 AS g')} SELECT round(avg(recall), 6) AS balanced_accuracy, round(sum(share * precision), 6) AS precision, round(sum(share * recall), 6) AS recall, round(sum(share * f1), 6) AS f1, round(sum(share * sqrt(recall * spec)), 6) AS gmean, round(sum(f1 * (1 - share)) / (count(*) - 1), 6) AS inverse_f1, (SELECT round(1 - avg(pow(l_extendedprice - l_quantity * 1000, 2)) / var_pop(l_quantity * 1000), 6) FROM lineitem) AS r2 FROM m")
def m07_swapped(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("label"), (F.col("l_suppkey") % 3).alias("prediction"), "l_extendedprice", (F.col("l_quantity") * 1000).alias("guess"))
    r2 = U.regression_scores(x, "l_extendedprice", "guess", swapped=True).select("r2")
    return rounded(U.classification_scores(U.confusion(x), swapped=True).crossJoin(r2))  # one row each


@query("m07_auc", "WITH x AS (SELECT l_quantity AS s, l_returnflag = 'R' AS y FROM lineitem), c AS (SELECT s, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM x GROUP BY 1), r AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM c) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 8) AS auc FROM r")
def m07b(spark, sf_dir):
    return rounded(U.rank_auc(table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag"), F.col("l_returnflag") == "R", "l_quantity"), 8)


@query("m08_regression", "SELECT round(avg(abs(l_extendedprice - l_quantity * 1000)), 3) AS mae, round(avg(pow(l_extendedprice - l_quantity * 1000, 2)), 0) AS mse, round(1 - avg(pow(l_extendedprice - l_quantity * 1000, 2)) / var_pop(l_extendedprice), 6) AS r2 FROM lineitem")
def m08(spark, sf_dir):
    x = U.regression_scores(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1000).alias("prediction")))
    return x.select(F.round("mae", 3).alias("mae"), F.round("mse", 0).alias("mse"), F.round("r2", 6).alias("r2"))


@query("m08_linear_model")
def m08b(spark, sf_dir):
    a, b, h = lines(spark, sf_dir)
    return rounded(U.utility(a, b, h, ["l_quantity", "l_discount"], "l_extendedprice", ["linear"]), 3)


@query("m09_cross_validation")
def m09(spark, sf_dir):
    return rounded(L.cross_validation(lines(spark, sf_dir)[0], "key", FEATURES, "returned", 3))


NEWTON = """WITH RECURSIVE o AS (SELECT o_orderkey % 3 AS fold, o_totalprice AS v, (o_totalprice + o_custkey % 1000 * 300 > 400000)::INTEGER AS y FROM orders),
    t AS (SELECT i, v, y FROM o, (SELECT unnest(range(3)) AS i) WHERE fold <> i), s AS (SELECT i, avg(v) AS mean, stddev_samp(v) AS dev, sum(y) AS yes, sum(1 - y) AS no FROM t GROUP BY 1),
    z AS (SELECT i, (v - mean) / dev AS z, y, CASE WHEN y = 1 THEN 0.5 / yes ELSE 0.5 / no END AS w FROM t JOIN s USING (i)),
    n(i, step, slope, base) AS (SELECT i, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM s UNION ALL
      SELECT i, step + 1, slope - (hb * (gs + 0.01 * slope) - hx * gb) / ((hs + 0.01) * hb - hx * hx), base - ((hs + 0.01) * gb - hx * (gs + 0.01 * slope)) / ((hs + 0.01) * hb - hx * hx)
      FROM (SELECT n.i, n.step, n.slope, n.base, sum(w * (p - y) * z) AS gs, sum(w * (p - y)) AS gb, sum(w * p * (1 - p) * z * z) AS hs, sum(w * p * (1 - p) * z) AS hx, sum(w * p * (1 - p)) AS hb
        FROM (SELECT n.*, z.z, z.y, z.w, 1 / (1 + exp(-(n.slope * z.z + n.base))) AS p FROM n JOIN z ON z.i = n.i WHERE n.step < 15) n GROUP BY 1, 2, 3, 4))
    SELECT CAST(i AS INTEGER) AS model, round(slope, 8) AS slope, round(base, 8) AS intercept FROM n WHERE step = 15"""


@query("m09_fold_coefficients", NEWTON)
def m09_coefficients(spark, sf_dir):
    """The models of a cross-validation over three folds, fitted together: on standardised prices, whether an order is large for its customer."""
    x = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("fold"), F.col("o_totalprice").alias("v"), (F.col("o_totalprice") + F.col("o_custkey") % 1000 * 300 > 400000).cast("int").alias("y"))
    models = L.fold_logistics(x, F.col("fold"), ["v"], "y", 3)
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(models.coefficients)], "model int, slope double, intercept double").select("model", F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept"))


@query("m10_mean_utility")
def m10(spark, sf_dir):
    a, b, h = lines(spark, sf_dir)
    return rounded(U.mean_utility(a, [b.where("l_orderkey % 4 = 1"), b.where("l_orderkey % 4 = 3")], h, FEATURES, "returned", "logistic"))


@query("m11_detection")
def m11(spark, sf_dir):
    a, b, _ = lines(spark, sf_dir)
    return rounded(U.detection(a, b, FEATURES), 4)


SMOTE = "m AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 10.0 AS y FROM supplier WHERE s_nationkey < 8), d AS (SELECT p.id, q.id AS other, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), q.id) AS k FROM m p JOIN m q ON p.id <> q.id)"


@query("m13_oversampled", f"WITH {SMOTE}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS c, CAST('0x' || substr(md5('0:' || id || ':1'), 1, 8) AS BIGINT) / 4294967296.0 AS u, CAST('0x' || substr(md5('1:' || id || ':1'), 1, 8) AS BIGINT) / 4294967296.0 AS v FROM d WHERE k <= 5) SELECT id AS s_suppkey, 1 AS copy, round(px + v * (qx - px), 4) AS x, round(py + v * (qy - py), 4) AS y FROM n WHERE k = floor(u * c) + 1")
def m13(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 10.0).alias("y"))
    return rounded(U.oversample(x, "s_suppkey", F.col("s_nationkey") < 8, ["x", "y"]), 4)


@query("m14_over_seeds", "SELECT l_returnflag, l_linestatus, count(l_discount) AS n, round(avg(l_discount), 8) AS mean, round(stddev_pop(l_discount), 8) AS std FROM lineitem GROUP BY 1, 2")
def m14(spark, sf_dir):
    return rounded(U.over_seeds(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount"), 8)
