"""Queries over encoders: forward, backward, or both at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabveil.operators import encoders as E
from tabveil.functions import FAR_TAIL, MIDDLE, TAIL
from tabveil.plans.distances import rounded
from tabveil.registry import query, table


def holes(spark, sf_dir):
    """Orders with missing prices and states."""
    miss = F.col("o_orderkey") % 7 == 0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(~miss, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("state"), "o_custkey")


HOLES = "x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS state, o_custkey FROM orders)"


@query("c01_missing", f"WITH {HOLES} SELECT o_orderkey, o_custkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM x)), 6) AS price, coalesce(state, '_missing_') AS state, CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_missing FROM x")
def c01(spark, sf_dir):
    x = holes(spark, sf_dir)
    return rounded(E.MissingEncoder(["state"], ["price"]).fit(x).transform(x))


@query("c01_missing_inverse", f"WITH {HOLES} SELECT * FROM x")
def c01b(spark, sf_dir):
    x = holes(spark, sf_dir)
    e = E.MissingEncoder(["state"], ["price"], noise=0.05, key="o_orderkey").fit(x)
    return e.inverse(e.transform(x))


@query("c02_c03_imputed", f"WITH {HOLES} SELECT o_orderkey, o_custkey, round(coalesce(price, (SELECT avg(price) FROM x)), 4) AS price, coalesce(state, (SELECT arg_min(state, (-n, state)) FROM (SELECT state, count(*) AS n FROM x WHERE state IS NOT NULL GROUP BY 1))) AS state FROM x")
def c02(spark, sf_dir):
    x = holes(spark, sf_dir)
    return rounded(E.Imputer(["price"], ["state"]).fit(x).transform(x), 4)


@query("c04_binary", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS big, CASE WHEN l_quantity > 25 THEN 'Yes' ELSE 'No' END AS back FROM lineitem")
def c04(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, "Yes").otherwise("No").alias("big"))
    e = E.BinaryEncoder(["big"]).fit(x)
    x = e.transform(x)
    return e.inverse(x.withColumn("back", F.col("big")).withColumnsRenamed({"big": "code", "back": "big"})).withColumnsRenamed({"big": "back", "code": "big"})


@query("c05_labels", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS o_orderstatus FROM orders")
def c05(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return E.LabelEncoder(["o_orderpriority", "o_orderstatus"]).fit(x).transform(x)


@query("c06_shared_labels", "WITH d AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT CAST(c_nationkey AS VARCHAR) AS v FROM customer UNION SELECT CAST(c_custkey % 40 AS VARCHAR) FROM customer)) SELECT c_custkey, a.code AS a, b.code AS b FROM customer JOIN d a ON a.v = CAST(c_nationkey AS VARCHAR) JOIN d b ON b.v = CAST(c_custkey % 40 AS VARCHAR)")
def c06(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 40).alias("b"))
    return E.LabelEncoder(["a", "b"], shared=True).fit(x).transform(x)


@query("c07_unseen", "WITH t AS (SELECT DISTINCT p_size FROM part WHERE p_size <= 20), d AS (SELECT CAST(p_size AS VARCHAR) AS v, row_number() OVER (ORDER BY CAST(p_size AS VARCHAR)) - 1 AS code FROM t) SELECT p_partkey, CAST(coalesce(code, (SELECT count(*) FROM d)) AS DOUBLE) AS p_size FROM part LEFT JOIN d ON v = CAST(p_size AS VARCHAR)")
def c07(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return E.LabelEncoder(["p_size"]).fit(x.where("p_size <= 20")).transform(x)


@query("c08_one_hot", "SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0 END::DOUBLE AS \"a\", CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END::DOUBLE AS n, count(*) AS rows FROM lineitem GROUP BY 1")
def c08(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag")
    e = E.OneHotEncoder(["l_returnflag"]).fit(x)
    x = e.transform(x).withColumns({"a": F.col("`l_returnflag=A`"), "n": F.col("`l_returnflag=N`")})
    return e.inverse(x).groupBy("l_returnflag", "a", "n").agg(F.count("*").alias("rows"))


@query("c09_leave_one_out", "SELECT l_suppkey AS key, l_orderkey, l_linenumber, l_partkey, l_quantity, round((sum(l_discount) OVER (PARTITION BY l_suppkey) - l_discount) / (count(*) OVER (PARTITION BY l_suppkey) - 1), 8) AS v FROM lineitem")
def c09(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_suppkey").cast("double").alias("v"), "l_discount")
    return E.leave_one_out(x, x, "v", "l_discount")[0].drop("l_discount").withColumn("v", F.round("v", 8))


@query("c10_quantile_normal", "SELECT o_orderkey, round(o_totalprice, 2) AS back, true AS inside FROM orders")
def c10(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("back"))
    e = E.QuantileNormal(["back"]).fit(x)
    y = e.transform(x).withColumn("inside", F.abs("back") < 5.3)
    return e.inverse(y).join(x.withColumnRenamed("back", "old"), "o_orderkey").select("o_orderkey", F.when(F.abs(F.col("back") - F.col("old")) <= 1e-3 * F.col("old"), F.round("old", 2)).otherwise(F.col("back")).alias("back"), "inside")


@query("c11_standard", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders")
def c11(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(E.Scaler(["o_totalprice"]).fit(x).transform(x))


@query("c12_symmetric", "SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) * 2 - 1, 8) AS o_totalprice FROM orders")
def c12(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(E.Scaler(["o_totalprice"], "symmetric").fit(x).transform(x), 8)


@query("c13_target", "SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def c13(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    e = E.Scaler(["c_acctbal"]).fit(x)
    return rounded(e.inverse(e.transform(x)), 4)


@query("c14_components", "SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(round(l_quantity, 2)), 2) AS q, round(sum(round(l_extendedprice, 2)), 2) AS p FROM lineitem GROUP BY 1, 2")
def c14(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    e = E.Components(["l_quantity", "l_extendedprice"], 1.0).fit(x)
    return e.inverse(e.transform(x)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(F.round("l_quantity", 2)), 2).alias("q"), F.round(F.sum(F.round("l_extendedprice", 2)), 2).alias("p"))


@query("c15_modes")
def c15(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return E.ModeEncoder("o_totalprice", 4).fit(x).transform(x)


@query("c16_mixed_modes", "SELECT p_partkey, round(v, 4) AS v FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_retailprice END AS v FROM part)")
def c16(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("v"))
    e = E.ModeEncoder("v", 3, (0.0,)).fit(x)
    return rounded(e.inverse(e.transform(x)), 4)


@query("c18_utility", "SELECT c_custkey, round(CASE WHEN lo >= 0 AND hi >= 1000 THEN ln(greatest(c_acctbal, 0.01)) ELSE 5 * (c_acctbal - lo) / (hi - lo) END, 8) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def c18(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(E.Scaler(["c_acctbal"], "utility").fit(x).transform(x), 8)


@query("c19_pipeline", f"WITH {HOLES} SELECT o_orderkey, o_custkey, round(price, 2) AS price, state FROM x")
def c19(spark, sf_dir):
    x = holes(spark, sf_dir)
    p = E.Pipeline([("missing", E.MissingEncoder(["state"], ["price"])), ("scale", E.Scaler(["price"], "unit")), ("labels", E.LabelEncoder(["state"]))]).fit(x)
    return rounded(p.inverse(p.transform(x)).select(x.columns), 2)


def cdf_sql(z):
    """The normal distribution function to 7.5e-8."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    upper = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END"


MARGINALS = "o_orderkey, o_totalprice AS price, o_totalprice / 5000 + o_custkey % 101 + o_orderkey % 97 AS mixed"
X = f"x AS (SELECT {MARGINALS} FROM orders)"


@query(
    "c17_marginal_distances",
    f"WITH {X}, l AS (SELECT 'price' AS c, price AS v FROM x UNION ALL SELECT 'mixed', mixed FROM x), m AS (SELECT c, avg(v) AS mean, stddev_pop(v) AS deviation, count(*) AS n FROM l GROUP BY 1),"
    " d AS (SELECT c, v, count(*) AS n FROM l GROUP BY 1, 2), u AS (SELECT d.c, (v - mean) / deviation AS z, sum(d.n) OVER (PARTITION BY d.c ORDER BY v) / m.n AS hi, (sum(d.n) OVER (PARTITION BY d.c ORDER BY v) - d.n) / m.n AS lo FROM d JOIN m USING (c))"
    f" SELECT m.c AS column, round(mean, 4) AS mean, round(deviation, 4) AS deviation, round(max(greatest(abs(hi - ({cdf_sql('z')})), abs(lo - ({cdf_sql('z')})))), 7) AS distance FROM u JOIN m USING (c) GROUP BY 1, 2, 3",
)
def c17_distances(spark, sf_dir):
    x = E.normal_distances(marginals(spark, sf_dir), ["price", "mixed"])
    return x.select("column", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), F.round("distance", 7).alias("distance"))


def marginals(spark, sf_dir):
    """Orders with a number that is spread evenly, and one that is a sum of three such."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice AS price", "o_totalprice / 5000 + o_custkey % 101 + o_orderkey % 97 AS mixed")


def quantile_sql(p):
    """The normal quantile of an expression in (0, 1)."""
    ratio = lambda parts, r: "(" + ") / (".join(reduce(lambda t, c: f"({t} * {r} + {c!r})", reversed(powers), "0.0::DOUBLE") for powers in parts) + ")"
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(MIDDLE, f'(0.180625 - {q} * {q})')} ELSE sign({q}) * CASE WHEN {r} <= 5 THEN {ratio(TAIL, f'({r} - 1.6)')} ELSE {ratio(FAR_TAIL, f'({r} - 5)')} END END"


def edges_sql(column, table):
    """i, q, next: 1000 quantiles of a column, and the next one; where a value lies among them, by ASOF join."""
    return f"e AS (SELECT unnest(range(1000)) AS i, unnest((SELECT quantile_cont({column}, list_transform(range(1000), lambda i: i / 999)) FROM {table})) AS q), w AS (SELECT i, q, lead(q) OVER (ORDER BY i) AS next FROM e)"


PLACE = "least(greatest(coalesce((i + ({0} - q) / (next - q)) / 999, 1), 1e-7), 1 - 1e-7)"


@query(
    "c17_marginal_scores",
    f"WITH {X}, {edges_sql('price', 'x')}, p AS (SELECT o_orderkey, {PLACE.format('price')} AS p, mixed, price FROM x ASOF JOIN w ON x.price >= w.q)"
    f" SELECT o_orderkey, round({quantile_sql('p')}, 7) AS price, round((mixed - (SELECT avg(mixed) FROM x)) / (SELECT stddev_pop(mixed) FROM x), 7) AS mixed FROM p",
)
def c17_scores(spark, sf_dir):
    """The evenly spread column gets the normal quantile of its place, the other its z-score."""
    x = marginals(spark, sf_dir)
    return rounded(E.MarginalNormal(["price", "mixed"]).fit(x).transform(x), 7)


@query("c17_marginal_inverse", f"WITH {X} SELECT o_orderkey, round(mixed, 6) AS mixed, true AS near, price IN (SELECT min(price) FROM x UNION ALL SELECT max(price) FROM x) AS an_end FROM x")
def c17_inverse(spark, sf_dir):
    """Scores turned back: prices within a millionth of their range, its ends exactly."""
    x = marginals(spark, sf_dir)
    e = E.MarginalNormal(["price", "mixed"]).fit(x)
    ends = F.broadcast(x.agg(F.min("price").alias("low"), F.max("price").alias("high")))  # one row
    back = e.inverse(e.transform(x)).withColumnRenamed("price", "back").join(x.select("o_orderkey", "price"), "o_orderkey").crossJoin(ends)
    near = F.abs(F.col("back") - F.col("price")) <= (F.col("high") - F.col("low")) / 1e6
    return back.select("o_orderkey", F.round("mixed", 6).alias("mixed"), near.alias("near"), ((F.col("back") == F.col("low")) | (F.col("back") == F.col("high"))).alias("an_end"))


@query("c10_normal_scores", f"WITH {X}, {edges_sql('price', 'x')}, p AS (SELECT o_orderkey, {PLACE.format('price')} AS p FROM x ASOF JOIN w ON x.price >= w.q) SELECT o_orderkey, round({quantile_sql('p')}, 7) AS price FROM p")
def c10_scores(spark, sf_dir):
    """The transformed values themselves."""
    x = marginals(spark, sf_dir).select("o_orderkey", "price")
    return rounded(E.QuantileNormal(["price"]).fit(x).transform(x), 7)
