"""Queries on privacy: customers of even keys are real, of odd keys synthetic, and every tenth is held out; orders and line items serve the counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.operators import densities
from tabveil.operators import privacy as P
from tabveil.operators import replicates, singling
from tabveil.plans.distances import rounded
from tabveil.plans.distances import A as LA
from tabveil.plans.distances import B as LB
from tabveil.registry import query, table

X = "c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0 AS y, c_nationkey AS nation, c_mktsegment AS segment"
REAL = f"a AS (SELECT {X} FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 2 = 0)"
SYNTHETIC = f"b AS (SELECT {X} FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 2 = 1)"
HOLD = f"h AS (SELECT {X} FROM customer WHERE c_custkey % 10 = 0)"
XY = ["x", "y"]


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))


def three(spark, sf_dir):
    x = customers(spark, sf_dir)
    return x.where("id % 10 > 0 AND id % 2 = 0"), x.where("id % 10 > 0 AND id % 2 = 1"), x.where("id % 10 = 0")


@query("d01_cluster_anonymity")
def d01(spark, sf_dir):
    return P.cluster_anonymity(*three(spark, sf_dir)[:2], XY)


@query("d02_k_anonymity", "SELECT min(n) AS k FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)")
def d02(spark, sf_dir):
    return P.k_anonymity(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("d03_cluster_diversity")
def d03(spark, sf_dir):
    return P.cluster_diversity(*three(spark, sf_dir)[:2], XY, ["nation", "segment"])


@query("d03_l_diversity", "SELECT min(n) AS l FROM (SELECT count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey)")
def d03b(spark, sf_dir):
    return P.l_diversity(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query("d04_k_map")
def d04(spark, sf_dir):
    return P.k_map(*three(spark, sf_dir)[:2], XY)


@query("d05_delta_presence")
def d05(spark, sf_dir):
    return P.delta_presence(*three(spark, sf_dir)[:2], XY)


@query("d05_class_presence", f"SELECT round(max(n / (m + 1e-8)), 8) AS delta FROM (SELECT l_partkey % 1000 AS k, count(*) AS n FROM {LA} GROUP BY 1) JOIN (SELECT l_partkey % 1000 AS k, count(*) AS m FROM {LB} GROUP BY 1) USING (k)")
def d05b(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 >= 2").select("l_orderkey", (F.col("l_partkey") % 1000).alias("k"))
    return rounded(P.class_presence(x.where("l_orderkey % 2 = 0"), x.where("l_orderkey % 2 = 1"), ["k"]), 8)


DIST = "sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))"


def z(t, by=None):
    return f"(SELECT id, (x - (SELECT avg(x) FROM {by or t})) / (SELECT stddev_pop(x) FROM {by or t}) AS x, (y - (SELECT avg(y) FROM {by or t})) / (SELECT stddev_pop(y) FROM {by or t}) AS y FROM {t})"


@query("d06_reidentification", f"WITH {REAL}, {SYNTHETIC}, w AS (SELECT (SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY round(x))) AS hx, (SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY round(y))) AS hy), o AS (SELECT p.id, min(sqrt(pow((p.x - q.x) / hx, 2) + pow((p.y - q.y) / hy, 2))) AS d FROM w, a p JOIN a q ON p.id <> q.id GROUP BY 1), s AS (SELECT p.id, min(sqrt(pow((p.x - q.x) / hx, 2) + pow((p.y - q.y) / hy, 2))) AS d FROM w, a p, b q GROUP BY 1) SELECT round(avg(CASE WHEN s.d < o.d THEN 1.0 ELSE 0 END), 6) AS share FROM o JOIN s USING (id)")
def d06(spark, sf_dir):
    return rounded(P.reidentification(*three(spark, sf_dir)[:2], XY))


def closeness(pairs):
    return f"d AS (SELECT id, list_sort(list(d))[1] AS d1, list_sort(list(d))[2] AS d2 FROM ({pairs}) GROUP BY 1) SELECT round(quantile_cont(d1, 0.05), 6) AS dcr, round(quantile_cont(d1 / d2, 0.05), 6) AS nndr FROM d"


@query("d07_d08_closest_record", f"WITH {REAL}, {SYNTHETIC}, za AS {z('a')}, zb AS {z('b')}, " + closeness(f"SELECT p.id, {DIST} AS d FROM za p, zb q"))
def d07(spark, sf_dir):
    return rounded(P.closest_record(*three(spark, sf_dir)[:2], XY))


FULL_REAL, FULL_SYNTHETIC, FULL_HOLD = (f"{t} AS (SELECT {X} FROM customer WHERE {w})" for t, w in (("a", "c_custkey % 2 = 0"), ("b", "c_custkey % 2 = 1"), ("h", "c_custkey % 10 = 0")))


def halves(spark, sf_dir):
    """All customers: those of even keys as real, those of odd ones as synthetic."""
    x = customers(spark, sf_dir)
    return x.where("id % 2 = 0"), x.where("id % 2 = 1")


def drawn(t, side):
    return f"SELECT r, id, x, y FROM {t}, (SELECT unnest(range(100)) AS r) WHERE CAST('0x' || substr(md5('{side}:' || (r // 4) || ':' || id), 8 * (r % 4) + 1, 8) AS BIGINT) < 644245094"


@query(
    "d07_d08_bootstrapped",
    f"""WITH {FULL_REAL}, {FULL_SYNTHETIC}, ra AS ({drawn('a', 0)}), rb AS ({drawn('b', 1)}),
    za AS (SELECT r, id, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS y FROM ra WINDOW w AS (PARTITION BY r)),
    zb AS (SELECT r, id, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS y FROM rb WINDOW w AS (PARTITION BY r)),
    d AS (SELECT r, id, list_sort(list(d), 'ASC')[1] AS d1, list_sort(list(d), 'ASC')[2] AS d2 FROM (SELECT p.r, p.id, {DIST} AS d FROM za p JOIN zb q USING (r)) GROUP BY 1, 2),
    m AS (SELECT r, quantile_cont(d1, 0.05) AS dcr, quantile_cont(d1 / d2, 0.05) AS nndr FROM d GROUP BY 1)
    SELECT round(avg(dcr), 8) AS dcr, round(avg(nndr), 8) AS nndr FROM m""",
)
def d07_bootstrapped(spark, sf_dir):
    return rounded(P.bootstrapped_closest_record(*halves(spark, sf_dir), XY), 8)


@query("d09_closest_within", f"WITH {REAL}, za AS {z('a')}, " + closeness(f"SELECT p.id, {DIST} AS d FROM za p JOIN za q ON p.id <> q.id"))
def d09(spark, sf_dir):
    return rounded(P.closest_within(three(spark, sf_dir)[0], XY))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
L1 = "abs(p.x - q.x) / r + CASE WHEN p.segment = q.segment THEN 0 ELSE 2 END"


@query("d10_train_closeness", f"WITH {REAL}, {SYNTHETIC}, {HOLD}, w AS (SELECT max(x) - min(x) AS r FROM a), t AS (SELECT p.id, min({L1}) AS d FROM w, b p, a q GROUP BY 1), u AS (SELECT p.id, min({L1}) AS d FROM w, b p, h q GROUP BY 1) SELECT round(avg(CASE WHEN t.d < u.d THEN 1.0 ELSE 0 END), 3) AS share FROM t JOIN u USING (id)")
def d10(spark, sf_dir):
    a, b, h = three(spark, sf_dir)
    return rounded(P.train_closeness(a, h, b, ["x"], {"segment": SEGMENTS}), 3)


@query("d11_attribution", f"WITH {REAL}, {SYNTHETIC}, k AS (SELECT nation, segment, count(*) AS hit FROM b GROUP BY 1, 2), t AS (SELECT nation, count(*) AS n FROM b GROUP BY 1) SELECT round(1 - avg(coalesce(hit / n, 0)), 8) AS cap FROM a LEFT JOIN k USING (nation, segment) LEFT JOIN t USING (nation)")
def d11(spark, sf_dir):
    return rounded(P.attribution(*three(spark, sf_dir)[:2], ["nation"], "segment"), 8)


@query("d12_generalised_attribution", f"WITH {REAL}, {SYNTHETIC}, p AS (SELECT a.id, a.segment = b.segment AS hit, (a.nation = b.nation)::INTEGER + (floor(a.x / 100) = floor(b.x / 100))::INTEGER AS s FROM a, b), m AS (SELECT id, max(s) AS s FROM p GROUP BY 1), q AS (SELECT id, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS v FROM p JOIN m USING (id, s) GROUP BY 1) SELECT round(1 - avg(v), 8) AS cap FROM q")
def d12(spark, sf_dir):
    a, b = (d.withColumn("band", F.floor(F.col("x") / 100)) for d in three(spark, sf_dir)[:2])
    return rounded(P.generalised_attribution(a, b, ["nation", "band"], "segment"), 8)


def lone(t, c):
    return f"(SELECT {c} AS v FROM {t} GROUP BY 1 HAVING count(*) = 1)"


@query("d13_singling_out", f"WITH {REAL}, {SYNTHETIC}, {HOLD}, g AS (SELECT CAST(v AS VARCHAR) AS v FROM {lone('b', 'floor(x)::BIGINT')} ORDER BY substr(md5('0:band:' || v), 1, 8), v LIMIT 500) SELECT count(*) AS attacks, count(*) FILTER (WHERE v IN (SELECT CAST(v AS VARCHAR) FROM {lone('a', 'floor(x)::BIGINT')})) AS success, count(*) FILTER (WHERE v IN (SELECT CAST(v AS VARCHAR) FROM {lone('h', 'floor(x)::BIGINT')})) AS control FROM g")
def d13(spark, sf_dir):
    a, b, h = (d.withColumn("band", F.floor("x")) for d in three(spark, sf_dir))
    return P.singling_out(a, h, b, ["band"])


@query("d13_multivariate_singling_out", "WITH " + f"{REAL}, {SYNTHETIC}, {HOLD}, " + ", ".join(f"{t}1 AS (SELECT nation, segment, floor(x / 500)::BIGINT AS band FROM {t} GROUP BY 1, 2, 3 HAVING count(*) = 1)" for t in "abh") + ", g AS (SELECT * FROM b1 ORDER BY substr(md5('0:' || nation || ':' || segment || ':' || band), 1, 8), nation, segment, band LIMIT 500) SELECT (SELECT count(*) FROM g) AS attacks, (SELECT count(*) FROM g JOIN a1 USING (nation, segment, band)) AS success, (SELECT count(*) FROM g JOIN h1 USING (nation, segment, band)) AS control")
def d13b(spark, sf_dir):
    a, b, h = (d.withColumn("band", F.floor(F.col("x") / 500)) for d in three(spark, sf_dir))
    return P.multivariate_singling_out(a, h, b, ["nation", "segment", "band"])


def nearest(c, k):
    return f"(SELECT id, other FROM (SELECT p.id, q.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.{c} - q.{c}), q.id) AS k FROM h p, b q) WHERE k <= {k})"


@query("d14_linkability", f"WITH {SYNTHETIC}, {HOLD} SELECT (SELECT count(*) FROM h) AS targets, (SELECT count(DISTINCT id) FROM (SELECT * FROM {nearest('x', 50)} INTERSECT SELECT * FROM {nearest('y', 50)})) AS links")
def d14(spark, sf_dir):
    _, b, h = three(spark, sf_dir)
    return P.linkability(h, b, ["x"], ["y"], 50)


def ranked(t, c):
    return f"(SELECT id, other, k FROM (SELECT p.id, q.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.{c} - q.{c}), q.id) AS k FROM {t} p, b q) WHERE k <= 10)"


def linked(t):
    return f"(SELECT id, min(greatest(u.k, v.k)) AS k FROM {ranked(t, 'x')} u JOIN {ranked(t, 'v')} v USING (id, other) GROUP BY 1)"


V = "c_custkey AS id, c_acctbal AS x, c_acctbal + c_nationkey * 20 AS v"


@query(
    "d14_linkability_ks",
    f"""WITH a AS (SELECT {V} FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 2 = 0 ORDER BY substr(md5('0:' || c_custkey), 1, 8), c_custkey LIMIT 5000),
    h AS (SELECT {V} FROM customer WHERE c_custkey % 10 = 0 ORDER BY substr(md5('0:' || c_custkey), 1, 8), c_custkey LIMIT 5000), b AS (SELECT {V} FROM customer WHERE c_custkey % 2 = 1),
    la AS {linked('a')}, lh AS {linked('h')}, n AS (SELECT count(*) AS n FROM b)
    SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM a) AS attacks, (SELECT count(*) FROM la WHERE la.k <= i.k) AS success, (SELECT count(*) FROM h) AS controls, (SELECT count(*) FROM lh WHERE lh.k <= i.k) AS control_success,
      round(1 - (SELECT product((n - i.k - j) / (n - j)) FROM (SELECT unnest(range(10)) AS j) WHERE j < i.k), 9) AS baseline
    FROM (SELECT unnest(range(4, 11)) AS k) i, n""",
)
def d14_ks(spark, sf_dir):
    """The hold-out is the control; a target is known by its balance, and by a number that depends on balance and nation."""
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") + F.col("c_nationkey") * 20).alias("v"))
    found = P.linkability_risks(x.where("id % 10 > 0 AND id % 2 = 0"), x.where("id % 10 = 0"), x.where("id % 2 = 1"), ["x"], ["v"])
    return found.withColumn("baseline", F.round("baseline", 9))


@query("d15_inference", f"WITH {SYNTHETIC}, {HOLD}, n AS (SELECT id, other FROM (SELECT p.id, q.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY {DIST}, q.id) AS k FROM h p, b q) WHERE k = 1) SELECT count(*) AS targets, count(*) FILTER (WHERE h.segment = b.segment) AS hits FROM n JOIN h ON n.id = h.id JOIN b ON n.other = b.id")
def d15(spark, sf_dir):
    _, b, h = three(spark, sf_dir)
    return P.inference(h, b, XY, "segment")


W = "(({0} / {1} + 1.9207294103470667 / {1}) / (1 + 3.8414588206941334 / {1}))"


@query("d16_attack_risk", f"WITH r AS (SELECT o_custkey % 10 AS g, count(*) AS attacks, count(*) FILTER (WHERE o_orderstatus = 'F') AS success, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS control FROM orders GROUP BY 1) SELECT g, round({W.format('success', 'attacks')}, 8) AS rate, round(greatest(({W.format('success', 'attacks')} - {W.format('control', 'attacks')}) / (1 - {W.format('control', 'attacks')}), 0), 8) AS risk FROM r")
def d16(spark, sf_dir):
    x = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("g")).agg(F.count("*").alias("attacks"), F.count_if(F.col("o_orderstatus") == "F").alias("success"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("control"))
    return rounded(P.attack_risk(x).select("g", "rate", "risk"), 8)


def density(t):
    return " ".join(f"- pow((p.{c} - (SELECT avg({c}) FROM {t})) / ((SELECT stddev_pop({c}) FROM {t}) + 1e-10), 2) / 2 - ln((SELECT stddev_pop({c}) FROM {t}) + 1e-10)" for c in XY)


@query("d17_membership", f"WITH {REAL}, {SYNTHETIC}, {HOLD}, u AS (SELECT x, y, 1 AS member FROM a UNION ALL SELECT x, y, 0 FROM h), s AS (SELECT member, round(0 {density('b')} - (0 {density('h')}), 9) AS score FROM u p), c AS (SELECT quantile_cont(score, 0.5) AS cut FROM s) SELECT round((SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) FROM s p JOIN s n ON p.member = 1 AND n.member = 0), 4) AS auc, round((SELECT avg(CASE WHEN (score > cut) = (member = 1) THEN 1.0 ELSE 0 END) FROM s, c), 3) AS accuracy")
def d17(spark, sf_dir):
    a, b, h = three(spark, sf_dir)
    x = P.membership(a, h, b, XY)
    return x.select(F.round("auc", 4).alias("auc"), F.round("accuracy", 3).alias("accuracy"))


def kde(points, data):
    """The Gaussian kernel density of a table of (x, y) at points, bandwidths by Scott's rule."""
    c = f"(SELECT count(*) AS n, covar_samp(x, x) * pow(count(*), -1.0 / 3) AS a, covar_samp(x, y) * pow(count(*), -1.0 / 3) AS b, covar_samp(y, y) * pow(count(*), -1.0 / 3) AS d FROM {data})"
    power = "-(c.d * pow(p.x - q.x, 2) - 2 * c.b * (p.x - q.x) * (p.y - q.y) + c.a * pow(p.y - q.y, 2)) / (2 * (c.a * c.d - c.b * c.b))"
    return f"(SELECT p.id, sum(exp({power})) / any_value(c.n * 2 * pi() * sqrt(c.a * c.d - c.b * c.b)) AS density FROM {points} p, {data} q, {c} c GROUP BY 1)"


def attacked(mode, reference):
    """The rows of the attack with a reference density, and how it does."""
    return f"""(WITH s AS (SELECT member, g.density / (r.density + 1e-10) AS score FROM u JOIN g USING (id) JOIN {reference} r USING (id)), cut AS (SELECT quantile_cont(score, 0.5) AS cut FROM s)
      SELECT '{mode}' AS mode, round((SELECT avg(CASE WHEN (score > cut) = member THEN 1.0 ELSE 0 END) FROM s, cut), 8) AS accuracy,
        round((SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) FROM s p JOIN s n ON p.member AND NOT n.member), 8) AS auc)"""


@query(
    "d17_density_membership",
    f"""WITH a AS (SELECT {X} FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 2 = 0), b AS (SELECT {X} FROM customer WHERE c_custkey % 2 = 1), h AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM (SELECT {X} FROM customer WHERE c_custkey % 10 = 0)),
    u AS (SELECT id, x, y, true AS member FROM a UNION ALL SELECT id, x, y, false FROM h WHERE i < floor(n * 0.7)), k AS (SELECT * FROM h WHERE i >= n - floor(n * 0.7)), o AS (SELECT * FROM h WHERE i >= floor(n * 0.7)),
    g AS {kde('u', 'b')}, w AS (SELECT x, y FROM a UNION ALL SELECT x, y FROM h),
    z AS (SELECT id, exp(-pow((u.x - (SELECT avg(x) FROM w)) / (SELECT stddev_pop(x) FROM w), 2) / 2 - pow((u.y - (SELECT avg(y) FROM w)) / (SELECT stddev_pop(y) FROM w), 2) / 2) / (2 * pi() * (SELECT stddev_pop(x) * stddev_pop(y) FROM w)) AS density FROM u)
    SELECT * FROM {attacked('kde', kde('u', 'k'))} UNION ALL SELECT * FROM {attacked('kde, disjoint', kde('u', 'o'))} UNION ALL SELECT * FROM {attacked('prior', 'z')}""",
)
def d17_density(spark, sf_dir):
    x = customers(spark, sf_dir)
    sides = x.where("id % 10 > 0 AND id % 2 = 0"), x.where("id % 10 = 0"), x.where("id % 2 = 1")
    told = [densities.density_membership(*sides, XY, mode, disjoint).select(F.lit(name).alias("mode"), "accuracy", "auc") for name, mode, disjoint in (("kde", "kde", False), ("kde, disjoint", "kde", True), ("prior", "prior", False))]
    return rounded(told[0].unionByName(told[1]).unionByName(told[2]), 8)


@query("d17_kernel_membership", f"WITH {SYNTHETIC}, {HOLD} SELECT p.id, count(q.id) AS density FROM h p LEFT JOIN b q ON {DIST} <= 300 GROUP BY 1")
def d17b(spark, sf_dir):
    _, b, h = three(spark, sf_dir)
    return P.kernel_membership(h.select("id", *XY), b, XY, 300.0)


@query("d18_replicated", "SELECT round(avg(v), 6) AS mean_mean, round(stddev_pop(v), 6) AS mean_std FROM (" + " UNION ALL ".join(f"SELECT avg(o_totalprice) AS v FROM orders WHERE CAST('0x' || substr(md5('{i}:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.15" for i in range(5)) + ")")
def d18(spark, sf_dir):
    return rounded(replicates.over_replicates(replicates.unit_lists(table(spark, sf_dir, "orders"), "o_orderkey", 5, 0.15), {"mean": F.avg("o_totalprice")}))


@query(
    "d18_replicates_in_one_scan",
    "WITH s AS (SELECT r, o_totalprice AS x FROM orders, (SELECT unnest(range(100)) AS r) WHERE CAST('0x' || substr(md5('0:' || (r // 4) || ':' || o_orderkey), 8 * (r % 4) + 1, 8) AS BIGINT) < 644245094), m AS (SELECT r, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS dev, skewness(x) AS skew FROM s GROUP BY 1)"
    " SELECT round(avg(n), 6) AS n_mean, round(stddev_pop(n), 6) AS n_std, round(avg(mean), 4) AS mean_mean, round(stddev_pop(mean), 4) AS mean_std, round(avg(dev), 4) AS dev_mean, round(stddev_pop(dev), 4) AS dev_std FROM m",
)
def d18_once(spark, sf_dir):
    x = replicates.over_replicates(replicates.replicate_lists(table(spark, sf_dir, "orders"), "o_orderkey", 100, 0.15), {"n": F.count("*"), "mean": F.avg("o_totalprice"), "dev": F.stddev_pop("o_totalprice")})
    return x.select(*[F.round(c, 6 if c[0] == "n" else 4).alias(c) for c in x.columns])


NUMBERS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber", "part": "l_partkey", "supplier": "l_suppkey"}
TEXTS = {"flag": "l_returnflag", "status": "l_linestatus"}
TRIES = 1000


def singling_sql():
    """Predicates as bounds of each column, NULL where a column isn't asked, against all rows."""
    names = [*NUMBERS, *TEXTS]
    columns = ", ".join([*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in NUMBERS.items()], *[f"{e} AS {c}" for c, e in TEXTS.items()]])
    tables = ", ".join(f"{t} AS (SELECT l_orderkey || '-' || l_partkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id, {columns} FROM lineitem WHERE {w})" for t, w in (("a", "l_orderkey % 2 = 0 AND l_orderkey % 10 > 0"), ("h", "l_orderkey % 10 = 0"), ("b", "l_orderkey % 2 = 1")))
    bound = lambda c, op, v: f"CASE WHEN o{c} IN ('=', '{op}') THEN {v} END"
    as_bounds = ", ".join([*[f"{bound(c, '>=', c)} AS {c}_lo, {bound(c, '<=', c)} AS {c}_hi" for c in NUMBERS], *[f"CASE WHEN o{c} = '=' THEN {c} END AS {c}_is" for c in TEXTS]])
    inside = " AND ".join([*[f"(p.{c}_lo IS NULL OR t.{c} >= p.{c}_lo) AND (p.{c}_hi IS NULL OR t.{c} <= p.{c}_hi)" for c in NUMBERS], *[f"(p.{c}_is IS NULL OR t.{c} = p.{c}_is)" for c in TEXTS]])
    counted = lambda t, p: f"(SELECT pid FROM {p} p JOIN {t} t ON {inside} GROUP BY 1 HAVING count(*) = 1)"
    pick = lambda n, key: f"list_sort([{', '.join(f'md5({key} || ' + chr(39) + ':' + c + chr(39) + ')' for c in names)}])[{min(n, len(names))}]"  # noqa: E731  the last hash that is picked
    parts = []
    for n in (2, 4, 8):
        ops = ", ".join(f"CASE WHEN md5('{n}:' || id || ':{c}') <= {pick(n, chr(39) + str(n) + ':' + chr(39) + ' || id')} THEN " + (f"CASE WHEN {c} > (SELECT quantile_cont({c}, 0.5) FROM b) THEN '>=' ELSE '<=' END" if c in NUMBERS else "'='") + f" END AS o{c}" for c in names)
        parts.append(f"SELECT md5('{n}:' || id) AS pid, {n} AS n_columns, 'attack' AS kind, {as_bounds} FROM (SELECT *, {ops} FROM r)")
    for n in (1, 2, 4, 8):
        drawn = " JOIN ".join(f"(SELECT {c}, row_number() OVER (ORDER BY md5('draw:{n}:{c}:' || id), id) AS i FROM r) AS d{c}" + ("" if k == 0 else " USING (i)") for k, c in enumerate(names))
        key = f"'order:{n}:' || i"
        ops = ", ".join(f"CASE WHEN md5({key} || ':{c}') <= {pick(n, key)} THEN " + (f"CASE WHEN substr(md5('pick:{n}:' || i || ':{c}'), 1, 1) < '8' THEN '<=' ELSE '>=' END" if c in NUMBERS else "'='") + f" END AS o{c}" for c in names)
        parts.append(f"SELECT md5('guess:{n}:' || i) AS pid, {n} AS n_columns, 'guess' AS kind, {as_bounds} FROM (SELECT *, {ops} FROM {drawn} WHERE i <= 500)")
    lone = []
    for c in names:
        ends = [("=", "true"), *([("<=", f"{c} = (SELECT min({c}) FROM b)"), (">=", f"{c} = (SELECT max({c}) FROM b)")] if c in NUMBERS else [])]
        lone += [f"SELECT md5('{c}:{op}:' || {c}) AS pid, 1 AS n_columns, 'attack' AS kind, {as_bounds} FROM (SELECT " + ", ".join(f"{x}, {repr(op) if x == c else 'NULL'} AS o{x}" if x == c else f"NULL AS {x}, NULL AS o{x}" for x in names) + f" FROM b GROUP BY {c} HAVING count(*) = 1 AND {w})" for op, w in ends]
    one = f"SELECT * FROM ({' UNION ALL '.join(lone)}) ORDER BY pid LIMIT 500"
    return f"""WITH {tables}, r AS (SELECT * FROM b ORDER BY md5('0:' || id), id LIMIT {TRIES}), e AS ({one}), p AS (SELECT * FROM e UNION ALL {' UNION ALL '.join(parts)}),
    q AS (SELECT *, row_number() OVER (PARTITION BY n_columns ORDER BY pid) AS i FROM p WHERE kind = 'attack' AND pid IN {counted('b', "(SELECT * FROM p WHERE kind = 'attack')")}),
    k AS (SELECT * EXCLUDE (i) FROM q WHERE i <= 500 UNION ALL SELECT * FROM p WHERE kind = 'guess'), ha AS {counted('a', 'k')}, hh AS {counted('h', 'k')}
    SELECT n_columns, count(*) FILTER (WHERE kind = 'attack') AS attacks, count(*) FILTER (WHERE kind = 'attack' AND pid IN (SELECT pid FROM ha)) AS success, count(*) FILTER (WHERE kind = 'attack' AND pid IN (SELECT pid FROM hh)) AS control,
      count(*) FILTER (WHERE kind = 'guess') AS guesses, count(*) FILTER (WHERE kind = 'guess' AND pid IN (SELECT pid FROM ha)) AS baseline FROM k GROUP BY 1"""


@query("d13_singling_out_sets", singling_sql())
def d13_sets(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"), "l_orderkey", *[F.col(e).alias(c) for c, e in (NUMBERS | TEXTS).items()])
    real, control, synthetic = x.where("l_orderkey % 2 = 0 AND l_orderkey % 10 > 0"), x.where("l_orderkey % 10 = 0"), x.where("l_orderkey % 2 = 1")
    return singling.singling_out_risks(real, control, synthetic, list(NUMBERS), list(TEXTS), tries=TRIES)
