"""Queries that compare real with synthetic rows: line items of even with those of odd order keys, outside the hold-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.operators import distances as D
from tabveil.plans.aggregates import shares_sql
from tabveil.registry import query, table

A = "(SELECT * FROM lineitem WHERE l_orderkey % 10 >= 2 AND l_orderkey % 2 = 0)"
B = "(SELECT * FROM lineitem WHERE l_orderkey % 10 >= 2 AND l_orderkey % 2 = 1)"
DISCRETE, CONTINUOUS = ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"]


def pair(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", *DISCRETE, *CONTINUOUS, "l_tax").where("l_orderkey % 10 >= 2")
    return x.where("l_orderkey % 2 = 0"), x.where("l_orderkey % 2 = 1")


def rounded(df, n=6):
    return df.withColumns({c: F.round(c, n) for c, t in df.dtypes if t == "double"})


J = "WITH " + shares_sql(A, B, *DISCRETE) + " "


@query("e01_kl_discrete", J + "SELECT col AS column, round(sum(CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN CAST('inf' AS DOUBLE) ELSE p * ln(p / q) END), 6) AS value FROM j GROUP BY 1")
def e01(spark, sf_dir):
    return rounded(D.kl_discrete(*pair(spark, sf_dir), DISCRETE))


M = "CAST({0} AS DOUBLE)"
MOMENTS = "WITH " + ", ".join(
    f"{s} AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, avg({c}) AS mean, stddev_pop({c}) AS pop, var_samp({c}) AS var, avg(pow({c} - m, 3)) / pow(stddev_pop({c}), 3) AS skew, avg(pow({c} - m, 4)) / pow(var_pop({c}), 2) - 3 AS kurt, sum({c}) AS sum, min({c}) AS lo, max({c}) AS hi FROM (SELECT {c}, avg({c}) OVER () AS m FROM {t})" for c in CONTINUOUS) + ")"
    for s, t in (("r", A), ("s", B))
)


@query("e02_kl_normal", MOMENTS + " SELECT col AS column, round(ln(s.pop / r.pop) + (r.pop * r.pop + (r.mean - s.mean) * (r.mean - s.mean)) / (2 * s.pop * s.pop) - 0.5, 6) AS value FROM r JOIN s USING (col)")
def e02(spark, sf_dir):
    return rounded(D.kl_normal(*pair(spark, sf_dir), CONTINUOUS))


@query("e03_chi2_proportion", J + "SELECT col AS column, round(sum((p - q) * (p - q) / q), 6) AS value FROM j GROUP BY 1")
def e03(spark, sf_dir):
    return rounded(D.chi2_proportion(*pair(spark, sf_dir), DISCRETE))


def cdf(c, a=A, b=B):
    return f"SELECT '{c}' AS col, v, lag(v) OVER (ORDER BY v) AS previous, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS f, sum(m) OVER (ORDER BY v) / sum(m) OVER () AS g, n, m, n / sum(n) OVER () AS pn, m / sum(m) OVER () AS pm FROM (SELECT {c} AS v, sum(n) AS n, sum(m) AS m FROM (SELECT {c}, 1 AS n, 0 AS m FROM {a} UNION ALL SELECT {c}, 0, 1 FROM {b}) WHERE {c} IS NOT NULL GROUP BY 1)"


CDF = "WITH x AS (" + " UNION ALL ".join(map(cdf, CONTINUOUS)) + ") "


@query("e04_ks", CDF + "SELECT col AS column, round(max(abs(f - g)), 6) AS value FROM x GROUP BY 1")
def e04(spark, sf_dir):
    return rounded(D.kolmogorov_smirnov(*pair(spark, sf_dir), CONTINUOUS))


def cramer(t, a, b):
    return f"(SELECT sqrt(greatest(sum(n * n / (ra * cb)) - 1, 0) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) FROM (SELECT a, b, CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb FROM (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2)))"


PAIRS = [(a, b) for i, a in enumerate(DISCRETE) for b in DISCRETE[i + 1 :]]
NUMBERS = [(a, b) for i, a in enumerate(CONTINUOUS) for b in CONTINUOUS[i + 1 :]]


@query("e05_cramers_v", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs({cramer(A, a, b)} - {cramer(B, a, b)}), 6) AS value" for a, b in PAIRS))
def e05(spark, sf_dir):
    return rounded(D.cramers_difference(*pair(spark, sf_dir), DISCRETE))


@query("e06_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs((SELECT corr({a}, {b}) FROM {A}) - (SELECT corr({a}, {b}) FROM {B})), 6) AS value" for a, b in NUMBERS))
def e06(spark, sf_dir):
    return rounded(D.pearson_difference(*pair(spark, sf_dir), CONTINUOUS))


OFF = " + ".join(f"abs((SELECT corr({a}, {b}) FROM {A}) - (SELECT corr({a}, {b}) FROM {B}))" for a, b in NUMBERS)


@query("e07_correlation_distance", f"SELECT round(2 * ({OFF}) / 9, 6) AS value")
def e07(spark, sf_dir):
    return rounded(D.correlation_distance(*pair(spark, sf_dir), CONTINUOUS))


@query("e08_dwp_discrete", J + "SELECT col AS column, round(avg(abs(p - q)) / sqrt(2), 6) AS value FROM j WHERE n > 0 GROUP BY 1")
def e08(spark, sf_dir):
    return rounded(D.dwp_discrete(*pair(spark, sf_dir), DISCRETE))


@query("e09_dwp_continuous", MOMENTS + " SELECT col AS column, round(abs(r.mean - s.mean) / sqrt(2), 6) AS value FROM r JOIN s USING (col)")
def e09(spark, sf_dir):
    return rounded(D.dwp_continuous(*pair(spark, sf_dir), CONTINUOUS))


def z(t, a, b):
    return f"(SELECT covar_pop({a}, {b}) / ((stddev_samp({a}) + 1e-5) * (stddev_samp({b}) + 1e-5)) FROM {t})"


@query("e10_correlation_loss", "SELECT round((" + " + ".join(f"pow({z(A, a, b)} - {z(B, a, b)}, 2)" for a, b in NUMBERS) + ") / 3, 9) AS value")
def e10(spark, sf_dir):
    return rounded(D.correlation_loss(*pair(spark, sf_dir), CONTINUOUS), 9)


LOSS = " + ".join(f"pow(1 - (s.{m} + 1e-6) / (r.{m} + 1e-6), 2) / {k}" for k, m in enumerate(("mean", "var", "skew", "kurt"), 1))


@query("e11_moment_loss", MOMENTS + f" SELECT col AS column, round({LOSS}, 4) AS value FROM r JOIN s USING (col)")
def e11(spark, sf_dir):
    return rounded(D.moment_loss(*pair(spark, sf_dir), CONTINUOUS), 4)


@query("e12_normalised_moments", MOMENTS + " SELECT col AS column, round(" + " + ".join(f"abs(s.{m} / (SELECT sum({m}) FROM s) - r.{m} / (SELECT sum({m}) FROM r)) / {k}" for k, m in enumerate(("mean", "var", "skew", "kurt"), 1)) + ", 5) AS value FROM r JOIN s USING (col)")
def e12(spark, sf_dir):
    return rounded(D.normalised_moments(*pair(spark, sf_dir), CONTINUOUS), 5)


@query("e13_weighted_moments", MOMENTS + f" SELECT col AS column, round(ln(({LOSS}) * r.sum * r.sum), 4) AS value FROM r JOIN s USING (col)")
def e13(spark, sf_dir):
    return D.moment_loss(*pair(spark, sf_dir), CONTINUOUS, weight="squared_sum").select("column", F.round(F.ln("value"), 4).alias("value"))


@query("e14_moment_differences", MOMENTS + " SELECT col AS column, " + ", ".join(f"round(abs(r.{m} - s.{m}), 4) AS {m}" for m in ("mean", "var", "skew", "kurt")) + " FROM r JOIN s USING (col)")
def e14(spark, sf_dir):
    return rounded(D.moment_differences(*pair(spark, sf_dir), CONTINUOUS), 4)


@query("e15_sum_shares", MOMENTS + " SELECT round(sum(abs(r.sum / (SELECT sum(sum) FROM r) - s.sum / (SELECT sum(sum) FROM s))), 8) AS value FROM r JOIN s USING (col)")
def e15(spark, sf_dir):
    return rounded(D.sum_shares(*pair(spark, sf_dir), CONTINUOUS), 8)


@query("e16_jensen_shannon", J + "SELECT col AS column, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS value FROM j GROUP BY 1")
def e16(spark, sf_dir):
    return rounded(D.jensen_shannon(*pair(spark, sf_dir), DISCRETE))


@query("e17_wasserstein", CDF + "SELECT col AS column, round(sum(coalesce(abs((f - pn) - (g - pm)) * (v - previous), 0)) / (max(v) FILTER (WHERE n > 0) - min(v) FILTER (WHERE n > 0)), 6) AS value FROM x GROUP BY 1")
def e17(spark, sf_dir):
    return rounded(D.wasserstein(*pair(spark, sf_dir), CONTINUOUS))


def ratio(t, a, b):
    return f"(SELECT sqrt((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (sum(n * m * m) - pow(sum(n * m), 2) / sum(n) + sum(n * v))) FROM (SELECT count(*) AS n, avg({b}) AS m, var_pop({b}) AS v FROM {t} GROUP BY {a}))"


@query(
    "e18_associations",
    "SELECT round(sqrt(2 * (" + " + ".join([*(f"pow({cramer(A, a, b)} - {cramer(B, a, b)}, 2)" for a, b in PAIRS), *(f"pow((SELECT corr({a}, {b}) FROM {A}) - (SELECT corr({a}, {b}) FROM {B}), 2)" for a, b in NUMBERS[:1]), *(f"pow({ratio(A, a, b)} - {ratio(B, a, b)}, 2)" for a in DISCRETE for b in CONTINUOUS[:2])]) + ")), 6) AS value",
)
def e18(spark, sf_dir):
    return rounded(D.association_distance(*pair(spark, sf_dir), DISCRETE, CONTINUOUS[:2]))


@query("e19_column_shapes", CDF + ", " + shares_sql(A, B, *DISCRETE) + " SELECT col AS column, round(1 - max(abs(f - g)), 6) AS value FROM x GROUP BY 1 UNION ALL SELECT col, round(1 - sum(abs(p - q)) / 2, 6) FROM j GROUP BY 1")
def e19(spark, sf_dir):
    return rounded(D.column_shapes(*pair(spark, sf_dir), DISCRETE, CONTINUOUS))


def joint(t, a, b, n):
    return f"(SELECT {a} AS a, {b} AS b, count(*) / (SELECT count(*) FROM {t}) AS {n} FROM {t} GROUP BY 1, 2)"


@query("e20_pair_trends", " UNION ALL ".join([*(f"SELECT '{a}' AS a, '{b}' AS b, round(1 - abs((SELECT corr({a}, {b}) FROM {A}) - (SELECT corr({a}, {b}) FROM {B})) / 2, 6) AS value" for a, b in NUMBERS), *(f"SELECT '{a}', '{b}', round(1 - sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) FROM {joint(A, a, b, 'p')} FULL JOIN {joint(B, a, b, 'q')} USING (a, b)" for a, b in PAIRS)]))
def e20(spark, sf_dir):
    return rounded(D.pair_trends(*pair(spark, sf_dir), DISCRETE, CONTINUOUS))


@query("e21_coverage", MOMENTS + ", " + shares_sql(A, B, *DISCRETE) + " SELECT col AS column, round(greatest(1 - greatest((s.lo - r.lo) / (r.hi - r.lo), 0) - greatest((r.hi - s.hi) / (r.hi - r.lo), 0), 0), 6) AS value FROM r JOIN s USING (col) UNION ALL SELECT col, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), 6) FROM j WHERE n > 0 GROUP BY 1")
def e21(spark, sf_dir):
    return rounded(D.coverage(*pair(spark, sf_dir), DISCRETE, CONTINUOUS))


@query("e22_alpha_precision", f"WITH c AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d FROM {A}), x AS (SELECT sqrt(pow(l_quantity - q, 2) + pow(l_discount - d, 2)) AS d FROM {A}, c), y AS (SELECT sqrt(pow(l_quantity - q, 2) + pow(l_discount - c.d, 2)) AS d FROM {B}, c), k AS (SELECT unnest(range(1, 11)) / 10 AS alpha), z AS (SELECT alpha, (SELECT quantile_cont(d, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FROM x)[CAST(round(alpha * 10) AS INTEGER)] AS cut FROM k) SELECT alpha, round(avg(CASE WHEN y.d <= cut THEN 1.0 ELSE 0 END), 3) AS share FROM z, y GROUP BY 1")
def e22(spark, sf_dir):
    return rounded(D.alpha_precision(*pair(spark, sf_dir), ["l_quantity", "l_discount"]), 3)


@query(
    "e23_precision_recall",
    """WITH a AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer WHERE c_custkey % 2 = 1),
    ra AS (SELECT * FROM (SELECT p.id, p.x, p.y, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS r, row_number() OVER (PARTITION BY p.id ORDER BY pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS k FROM a p JOIN a q ON p.id <> q.id) WHERE k = 5),
    rb AS (SELECT * FROM (SELECT p.id, p.x, p.y, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS r, row_number() OVER (PARTITION BY p.id ORDER BY pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS k FROM b p JOIN b q ON p.id <> q.id) WHERE k = 5),
    h AS (SELECT ra.id, b.id AS other FROM ra JOIN b ON sqrt(pow(ra.x - b.x, 2) + pow(ra.y - b.y, 2)) <= r), g AS (SELECT rb.id, a.id AS other FROM rb JOIN a ON sqrt(pow(rb.x - a.x, 2) + pow(rb.y - a.y, 2)) <= r)
    SELECT round((SELECT count(DISTINCT other) FROM h) / (SELECT count(*) FROM b), 6) AS precision, round((SELECT count(DISTINCT other) FROM g) / (SELECT count(*) FROM a), 6) AS recall,
      round((SELECT count(*) FROM h) / (5 * (SELECT count(*) FROM b)), 6) AS density, round((SELECT count(DISTINCT id) FROM h) / (SELECT count(*) FROM a), 6) AS coverage""",
)
def e23(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    return rounded(D.precision_recall(x.where("id % 2 = 0"), x.where("id % 2 = 1"), ["x", "y"]))


@query("e24_imputation", "WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, arg_min(l_returnflag, (-n, l_returnflag)) AS guess FROM v GROUP BY 1) SELECT round(avg(CASE WHEN guess = CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'N' END THEN 1.0 ELSE 0 END), 6) AS value FROM orders LEFT JOIN g ON l_orderkey = o_orderkey")
def e24(spark, sf_dir):
    imputed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_returnflag").alias("v"))
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("v"))
    return rounded(D.imputation_score(imputed, truth, "row", "v"))


@query("e25_sample_score", J + f", d AS (SELECT col, avg(abs(p - q)) / sqrt(2) AS v FROM j WHERE n > 0 GROUP BY 1) SELECT round(2 * ({OFF}) / 9 + 10 * avg(v), 6) AS value FROM d")
def e25(spark, sf_dir):
    return rounded(D.sample_score(*pair(spark, sf_dir), DISCRETE, CONTINUOUS))


CUSTOMERS = "a AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer WHERE c_custkey % 2 = 1)"


def curves_sql(steps):
    centre = lambda t, c: f"sqrt(pow(c.x - (SELECT avg(x) FROM {t}), 2) + pow(c.y - (SELECT avg(y) FROM {t}), 2)) AS d"
    shares = "[" + ", ".join(repr(i / (steps - 1)) for i in range(steps)) + "]::DOUBLE[]"
    return f"""{CUSTOMERS}, o AS (SELECT p.id, min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS own FROM a p JOIN a q ON p.id <> q.id GROUP BY 1),
    n AS (SELECT p.id, min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS distance, arg_min(q.id, (sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), q.id)) AS other FROM a p, b q GROUP BY 1), r AS (SELECT {centre('b', 'c')}, distance <= own AS covered FROM n JOIN o USING (id) JOIN b c ON c.id = other),
    x AS (SELECT {centre('a', 'c')} FROM a c), y AS (SELECT {centre('a', 'c')} FROM b c),
    k AS (SELECT unnest({shares}) AS alpha, unnest((SELECT quantile_cont(d, {shares}) FROM x)) AS p, unnest((SELECT quantile_cont(d, {shares}) FROM r)) AS q),
    v AS (SELECT alpha, (SELECT avg(CASE WHEN d <= p * (1 + 1e-12) THEN 1.0 ELSE 0 END) FROM y) AS precision, (SELECT avg(CASE WHEN covered AND d <= q * (1 + 1e-12) THEN 1.0 ELSE 0 END) FROM r) AS recall FROM k)"""


def both(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    return x.where("id % 2 = 0"), x.where("id % 2 = 1")


@query("e22_support_curves", f"WITH {curves_sql(30)} SELECT round(alpha, 9) AS alpha, round(precision, 3) AS precision, round(recall, 3) AS recall FROM v")
def e22_curves(spark, sf_dir):
    x = D.support_curves(*both(spark, sf_dir), ["x", "y"])
    return x.select(F.round("alpha", 9).alias("alpha"), F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"))


@query("e22_support_scores", f"WITH {curves_sql(30)} SELECT round(1 - sum(abs(alpha - precision)) / sum(alpha), 3) AS precision, round(1 - sum(abs(alpha - recall)) / sum(alpha), 3) AS recall FROM v")
def e22_scores(spark, sf_dir):
    return rounded(D.support_scores(D.support_curves(*both(spark, sf_dir), ["x", "y"])), 3)


@query(
    "e24_imputation_auc",
    """WITH t AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'N' END AS c FROM orders), v AS (SELECT l_orderkey AS k, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1, 2),
    s AS (SELECT t.k, x.c, t.c = x.c AS hit, coalesce(v.n / (SELECT sum(n) FROM v z WHERE z.k = t.k), 0) AS s FROM t CROSS JOIN (SELECT DISTINCT c FROM t) x LEFT JOIN v ON v.k = t.k AND v.c = x.c),
    c AS (SELECT s, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg FROM s GROUP BY 1), u AS (SELECT *, sum(neg) OVER (ORDER BY s) AS upto FROM c),
    g AS (SELECT k, arg_min(c, (-s, c)) AS c FROM s GROUP BY 1)
    SELECT round((SELECT avg(CASE WHEN g.c = t.c THEN 1.0 ELSE 0 END) FROM t JOIN g USING (k)), 9) AS micro_f1, round(sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM u""",
)
def e24_auc(spark, sf_dir):
    imputed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_returnflag").alias("v"))
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("v"))
    return rounded(D.imputation_auc(imputed, truth, "row", "v"), 9)


@query(
    "e03_chi2_counts",
    f"WITH a AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1), {shares_sql('a', 'b', *DISCRETE)}, t AS (SELECT *, q * sum(n) OVER (PARTITION BY col) AS e FROM j)"
    " SELECT col AS column, round(sum((n - e) * (n - e) / e), 4) AS statistic, count(*) - 1 AS degrees, round(sqrt(sum((n - e) * (n - e) / e) / (sum((n - e) * (n - e) / e) + sum(n))), 7) AS contingency FROM t GROUP BY 1",
)
def e03_counts(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", *DISCRETE)
    x = D.chi2_counts(x.where("l_orderkey % 2 = 0"), x.where("l_orderkey % 2 = 1"), DISCRETE)
    return x.select("column", F.round("statistic", 4).alias("statistic"), "degrees", F.round("contingency", 7).alias("contingency"))


#: Line items with unknown flags and discounts.
FLAG, DISCOUNT = "CASE WHEN l_quantity <= 45 THEN l_returnflag END", "CASE WHEN l_linenumber <> 3 THEN l_discount END"
KINDS, AMOUNTS = ["flag", "l_linestatus"], ["discount", "l_extendedprice"]


def unknown_sql(mode, a, b):
    """What the six distances are between two tables with unknown values."""
    r, s = (f"(SELECT * FROM {t} WHERE flag IS NOT NULL)" if mode == "listwise" else t for t in (a, b))
    x, y = (f"(SELECT * FROM {t} WHERE discount IS NOT NULL)" if mode == "listwise" else t for t in (a, b))
    j, both = f"(WITH {shares_sql(r, s, *KINDS)} SELECT * FROM j)", lambda t: f"(SELECT * FROM {t} WHERE flag IS NOT NULL)"
    side = lambda t, c: f"(SELECT avg({c}) AS mean, stddev_pop({c}) AS pop FROM {t})"
    parts = [f"SELECT 'kl' AS metric, col, sum(CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN CAST('inf' AS DOUBLE) ELSE p * ln(p / q) END) AS value FROM {j} GROUP BY ALL", f"SELECT 'chi2', col, sum((p - q) * (p - q) / q) FROM {j} GROUP BY ALL"]
    for c in AMOUNTS:
        parts.append(f"SELECT 'kl normal', '{c}', ln(s.pop / r.pop) + (r.pop * r.pop + (r.mean - s.mean) * (r.mean - s.mean)) / (2 * s.pop * s.pop) - 0.5 FROM {side(x, c)} r, {side(y, c)} s")
        parts.append(f"SELECT 'ks', '{c}', max(abs(f - g)) FROM ({cdf(c, x, y)})")
    parts.append(f"SELECT 'pearson', 'discount, l_extendedprice', abs((SELECT corr(discount, l_extendedprice) FROM {x}) - (SELECT corr(discount, l_extendedprice) FROM {y}))")
    parts.append(f"SELECT 'cramer', 'flag, l_linestatus', abs({cramer(both(r), 'flag', 'l_linestatus')} - {cramer(both(s), 'flag', 'l_linestatus')})")
    return f"SELECT '{mode}' AS nulls, metric, col AS column, round(value, 6) AS value FROM ({' UNION ALL '.join(parts)})"


@query(
    "e01_e06_unknown_values",
    f"WITH x AS (SELECT l_orderkey % 2 AS side, l_linestatus, l_extendedprice, {FLAG} AS flag, {DISCOUNT} AS discount FROM lineitem), a AS (SELECT * FROM x WHERE side = 0), b AS (SELECT * FROM x WHERE side = 1) {unknown_sql('listwise', 'a', 'b')} UNION ALL {unknown_sql('columnwise', 'a', 'b')}",
)
def e01_e06(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2).alias("side"), "l_linestatus", "l_extendedprice", F.expr(FLAG).alias("flag"), F.expr(DISCOUNT).alias("discount"))
    a, b, out = x.where("side = 0"), x.where("side = 1"), None
    for nulls in ("listwise", "columnwise"):
        for metric, distance, columns in (("kl", D.kl_discrete, KINDS), ("chi2", D.chi2_proportion, KINDS), ("kl normal", D.kl_normal, AMOUNTS), ("ks", D.kolmogorov_smirnov, AMOUNTS), ("pearson", D.pearson_difference, AMOUNTS), ("cramer", D.cramers_difference, KINDS)):
            d = distance(a, b, columns, nulls)
            column = F.col("column") if "column" in d.columns else F.concat_ws(", ", "a", "b")
            d = d.select(F.lit(nulls).alias("nulls"), F.lit(metric).alias("metric"), column.alias("column"), F.round("value", 6).alias("value"))
            out = d if out is None else out.unionByName(d)
    return out
