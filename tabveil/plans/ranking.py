"""Queries over samples, windows and ranks. The score table is derived from lineitem: suppliers are datasets, ship flags models, yearly sums metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.operators import ranking, sampling
from tabveil.registry import query, table

R = lambda c, n=6: F.round(c, n).alias(c)
SCORES = """s AS (SELECT 'd' || (l_suppkey % 20) AS dataset, l_returnflag || l_linestatus AS model, 'm' || l_linenumber AS metric, round(avg(l_discount), 3) AS value,
  CASE WHEN l_linenumber % 2 = 0 THEN 'lower' ELSE 'higher' END AS direction FROM lineitem GROUP BY 1, 2, 3, 5)"""


def scores(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("d"), (F.col("l_suppkey") % 20).cast("string")).alias("dataset"), F.concat("l_returnflag", "l_linestatus").alias("model"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric"), F.when(F.col("l_linenumber") % 2 == 0, "lower").otherwise("higher").alias("direction"))
    return x.agg(F.round(F.avg("l_discount"), 3).alias("value"))


H = lambda seed, key: f"(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0)"


@query("n01_split", f"SELECT o_orderkey, CASE WHEN {H(0, 'o_orderkey')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders")
def n01(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("n02_covering_split", f"WITH x AS (SELECT o_orderkey, o_custkey, {H(0, 'o_orderkey')} AS h FROM orders) SELECT o_orderkey, o_custkey, CASE WHEN h < 0.5 OR row_number() OVER (PARTITION BY o_custkey ORDER BY h, o_orderkey) = 1 THEN 'train' ELSE 'test' END AS part FROM x")
def n02(spark, sf_dir):
    return sampling.covering_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], ["o_custkey"], 0.5)


@query("n03_stratified", f"WITH x AS (SELECT o_orderkey, o_orderstatus, {H(0, 'o_orderkey')} AS h FROM orders) SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.8) THEN 'train' ELSE 'test' END AS part FROM x")
def n03(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus")


@query("n04_folds", f"SELECT o_orderkey, CAST(floor({H(0, 'o_orderkey')} * 5) AS INTEGER) AS fold FROM orders")
def n04(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("n05_nested_samples", f"WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H(0, 'o_orderkey')}, o_orderkey) AS n FROM orders) SELECT o_orderkey, s AS sample_rows FROM x, (VALUES (50), (500), (5000)) t(s) WHERE n <= s")
def n05(spark, sf_dir):
    return sampling.nested_samples(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], [50, 500, 5000])


@query("n06_percent_sample", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {H(0, 'o_orderkey')} < 0.3")
def n06(spark, sf_dir):
    return sampling.percent_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 0.3, 1.0, "o_orderstatus")


@query("n07_covering_sample", f"WITH m AS (SELECT min(o_orderkey) AS k FROM orders GROUP BY o_custkey UNION SELECT min(o_orderkey) FROM orders GROUP BY o_orderstatus), x AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey IN (SELECT k FROM m) THEN 0 ELSE 1 END AS r FROM orders) SELECT o_orderkey, o_custkey FROM x QUALIFY r = 0 OR row_number() OVER (ORDER BY r, {H(0, 'o_orderkey')}, o_orderkey) <= 3000")
def n07(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sampling.covering_sample(x, "o_orderkey", ["o_custkey", "o_orderstatus"], 3000).select("o_orderkey", "o_custkey")


@query("n08_rebalanced", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR {H(0, 'o_orderkey')} < 0.25")
def n08(spark, sf_dir):
    return sampling.rebalance(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], F.col("o_orderstatus") == "F")


@query("n09_class_weights", "SELECT o_orderstatus, count(*) AS n, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)), 8) AS weight FROM orders GROUP BY 1")
def n09(spark, sf_dir):
    return sampling.class_weights(table(spark, sf_dir, "orders"), "o_orderstatus").withColumn("weight", F.round("weight", 8))


@query("n10_category_weights", "WITH x AS (SELECT 'p_brand' AS column, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2) SELECT *, round(ln(n + 1) / sum(ln(n + 1)) OVER (PARTITION BY \"column\"), 8) AS weight FROM x")
def n10(spark, sf_dir):
    return sampling.category_weights(table(spark, sf_dir, "part"), ["p_brand", "p_size"]).withColumn("weight", F.round("weight", 8))


@query("n11_pair_frequencies", " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n FROM lineitem GROUP BY 3, 4" for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"))))
def n11(spark, sf_dir):
    return sampling.pair_frequencies(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "n12_draws",
    f"""WITH c AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT *, ln(n + 1) / (SELECT sum(ln(n + 1)) FROM c) AS w FROM c),
    b AS (SELECT value, n, sum(w) OVER (ORDER BY value) - w AS lo FROM w), d AS (SELECT o_orderkey AS draw, {H(0, 'o_orderkey')} AS u, {H(1, 'o_orderkey')} AS v FROM orders),
    t AS (SELECT draw, v, arg_max(value, lo) AS value, arg_max(n, lo) AS n FROM d JOIN b ON lo <= u GROUP BY 1, 2),
    r AS (SELECT c_custkey, c_mktsegment AS value, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {H(2, 'c_custkey')}, c_custkey) AS nth FROM customer)
    SELECT draw, value, c_custkey FROM t JOIN r USING (value) WHERE nth = floor(v * n) + 1""",
)
def n12(spark, sf_dir):
    return sampling.draw_by_category(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw")))


@query("n14_bootstrap", f"WITH {SCORES} SELECT model, round(avg(value), 6) AS mean, true AS se_fits FROM s GROUP BY 1")
def n14(spark, sf_dir):
    x = sampling.bootstrap_means(scores(spark, sf_dir), ["dataset", "model", "metric"], "value", ["model"], 100)
    return x.select("model", R("mean"), F.col("se").between(0, F.col("mean")).alias("se_fits"))


@query("w01_average_rank", f"WITH {SCORES} SELECT dataset, model, metric, rank() OVER (PARTITION BY dataset, metric ORDER BY value) + (count(*) OVER (PARTITION BY dataset, metric, value) - 1) / 2 AS rank FROM s")
def w01(spark, sf_dir):
    return ranking.average_rank(scores(spark, sf_dir), ["dataset", "metric"], "value").select("dataset", "model", "metric", "rank")


@query("w02_reverse_rank", f"WITH {SCORES} SELECT dataset, model, metric, rank() OVER (PARTITION BY dataset, metric ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, metric, value) - 1) / 2 AS rank FROM s")
def w02(spark, sf_dir):
    return ranking.average_rank(scores(spark, sf_dir), ["dataset", "metric"], "value", True).select("dataset", "model", "metric", "rank")


CURVE = "c AS (SELECT l_returnflag AS metric, l_linenumber AS row_number, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1, 2)"


def curve(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.col("l_linenumber").alias("row_number")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value"))


@query("w03_elbow", f"WITH {CURVE}, d AS (SELECT *, lead(value) OVER (PARTITION BY metric ORDER BY row_number) - value AS step FROM c) SELECT metric, arg_min(row_number, (step, row_number)) AS elbow FROM d WHERE step IS NOT NULL GROUP BY 1")
def w03(spark, sf_dir):
    return ranking.elbow(curve(spark, sf_dir), ["metric"], "row_number", "value")


@query("w04_moving_average", f"WITH {CURVE} SELECT metric, row_number, CASE WHEN count(*) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS smooth FROM c WINDOW w AS (PARTITION BY metric ORDER BY row_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def w04(spark, sf_dir):
    return ranking.moving_average(curve(spark, sf_dir), ["metric"], "row_number", "value").select("metric", "row_number", R("smooth"))


@query("w05_best", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1")
def w05(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("o_totalprice"))
    return ranking.best(x, ["o_custkey"], "o_totalprice", ["o_orderkey"])


ORIENTED = "o AS (SELECT *, CASE WHEN direction = 'lower' THEN -value ELSE value END AS v FROM s)"
RANKS = f"""{SCORES}, {ORIENTED}, f AS (SELECT dataset, metric FROM s GROUP BY 1, 2 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM s)),
  r AS (SELECT dataset, metric, model, rank() OVER (PARTITION BY dataset, metric ORDER BY v) + (count(*) OVER (PARTITION BY dataset, metric, v) - 1) / 2 AS rank FROM o JOIN f USING (dataset, metric)),
  m AS (SELECT dataset, model, avg(rank) AS mean_rank FROM r GROUP BY 1, 2)"""


@query("r06_mean_ranks", f"WITH {RANKS} SELECT dataset, model, round(mean_rank, 6) AS mean_rank, CAST(row_number() OVER (PARTITION BY dataset ORDER BY mean_rank DESC, model) AS INTEGER) AS place FROM m")
def r06(spark, sf_dir):
    return ranking.mean_ranks(scores(spark, sf_dir)).select("dataset", "model", R("mean_rank"), "place")


@query("w06_places", "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer")
def w06(spark, sf_dir):
    return ranking.place(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey").drop("c_acctbal")


@query("r01_directions", f"WITH {SCORES} SELECT metric, count(*) AS n, CASE WHEN metric = 'm2' THEN 'lower' ELSE 'higher' END AS direction FROM s GROUP BY 1")
def r01(spark, sf_dir):
    d = spark.createDataFrame([("m2", "lower"), ("m", "higher")], "metric string, direction string")
    return ranking.with_direction(scores(spark, sf_dir).drop("direction"), d).groupBy("metric", "direction").agg(F.count("*").alias("n"))


@query("r02_oriented", f"WITH {SCORES} SELECT dataset, model, metric, CASE WHEN metric = 'm3' THEN -1e10 WHEN direction = 'lower' THEN -value ELSE value END AS v FROM s")
def r02(spark, sf_dir):
    v = F.when(F.col("metric") == "m3", float("nan")).otherwise(F.col("value"))
    return scores(spark, sf_dir).select("dataset", "model", "metric", ranking.oriented(v, F.col("direction")).alias("v"))


TRIALS = f"{SCORES}, t AS (SELECT dataset || model AS tid, metric, direction, value, dataset = 'd3' AS failed FROM s)"


def trials(spark, sf_dir):
    return scores(spark, sf_dir).select(F.concat("dataset", "model").alias("tid"), "metric", "direction", "value", (F.col("dataset") == "d3").alias("failed"))


@query("r03_rank_losses", f"WITH {TRIALS}, g AS (SELECT tid, metric, CASE WHEN direction = 'lower' THEN -value ELSE value END AS v FROM t WHERE NOT failed), r AS (SELECT tid, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2 AS r FROM g) SELECT tid, round(-avg(r), 6) AS loss FROM r GROUP BY 1 UNION ALL SELECT DISTINCT tid, CAST('inf' AS DOUBLE) FROM t WHERE failed")
def r03(spark, sf_dir):
    return ranking.rank_losses(trials(spark, sf_dir)).select("tid", R("loss"))


@query("r04_raw_losses", f"WITH {TRIALS} SELECT tid, CASE WHEN bool_or(failed) THEN CAST('inf' AS DOUBLE) ELSE round(-avg(CASE WHEN direction = 'lower' THEN -value ELSE value END), 6) END AS loss FROM t GROUP BY 1")
def r04(spark, sf_dir):
    return ranking.raw_losses(trials(spark, sf_dir)).select("tid", R("loss"))


@query("r05_imbalance_guard", "WITH x AS (SELECT l_suppkey AS tid, 'fold' || l_linenumber || CASE l_returnflag WHEN 'A' THEN '_gmean' WHEN 'N' THEN '_precision' ELSE '_f1' END AS metric, l_linenumber, max(CASE l_returnflag WHEN 'A' THEN l_discount ELSE l_discount * 10 + 0.1 END) AS value FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT tid, l_linenumber, bool_or(metric LIKE '%gmean' AND value > 0) AND bool_or(metric LIKE '%precision' AND value < 1) AS ok FROM x GROUP BY 1, 2) SELECT tid, metric, CASE WHEN ok THEN round(value, 6) END AS value FROM x JOIN k USING (tid, l_linenumber)")
def r05(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "_gmean").when(F.col("l_returnflag") == "N", "_precision").otherwise("_f1")
    value = F.max(F.when(F.col("l_returnflag") == "A", F.col("l_discount")).otherwise(F.col("l_discount") * 10 + 0.1))
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tid"), F.concat(F.lit("fold"), F.col("l_linenumber").cast("string"), kind).alias("metric")).agg(value.alias("value"))
    return ranking.imbalance_guard(x).select("tid", "metric", R("value"))


@query("r08_friedman", f"WITH {SCORES}, f AS (SELECT dataset, metric FROM s GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT model) FROM s)), x AS (SELECT s.*, rank() OVER (PARTITION BY dataset, metric ORDER BY value) + (count(*) OVER (PARTITION BY dataset, metric, value) - 1) / 2 AS r FROM s JOIN f USING (dataset, metric)), m AS (SELECT model, avg(r) AS m FROM x GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY dataset, metric, value)), z AS (SELECT (SELECT count(*) FROM m) AS k, (SELECT count(*) FROM f) AS n) SELECT k, n, round(12.0 * n / (k * (k + 1)) * (SELECT sum(m * m) - sum(m) * sum(m) / count(*) FROM m) / (1 - (SELECT t FROM t) / (n * k * (k * k - 1))), 5) AS statistic FROM z")
def r08(spark, sf_dir):
    x = scores(spark, sf_dir)
    k = x.agg(F.count_distinct("model").alias("_k"))
    whole = x.groupBy("dataset", "metric").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(k)).where("_n = _k").select("dataset", "metric")  # k is one row
    return ranking.friedman(x.join(whole, ["dataset", "metric"]), ["dataset", "metric"]).select("k", "n", R("statistic", 5))


@query("r07_rank_gaps", f"WITH {RANKS}, a AS (SELECT model, avg(rank) AS mean_rank FROM r GROUP BY 1) SELECT x.model AS a, y.model AS b, round(x.mean_rank - y.mean_rank, 6) AS gap, sign(x.mean_rank - y.mean_rank)::INTEGER AS direction FROM a x, a y WHERE x.model <> y.model")
def r07(spark, sf_dir):
    m = ranking.mean_ranks(scores(spark, sf_dir)).groupBy("model").agg(F.avg("mean_rank").alias("mean_rank"))
    return ranking.rank_gaps(m, 4, 140).select("a", "b", R("gap"), F.signum("gap").cast("int").alias("direction"))


@query("r09_marks")
def r09(spark, sf_dir):
    m = ranking.mean_ranks(scores(spark, sf_dir)).groupBy("model").agg(F.avg("mean_rank").alias("mean_rank"))
    return ranking.rank_gaps(m, 4, 140).select("a", "b", "mark")


@query("r10_win_rates", f"WITH {SCORES} SELECT x.model AS a, y.model AS b, round(avg(CASE WHEN x.value > y.value THEN 1.0 WHEN x.value = y.value THEN 0.5 ELSE 0 END), 6) AS win_rate FROM s x JOIN s y USING (dataset, metric) WHERE x.model <> y.model GROUP BY 1, 2")
def r10(spark, sf_dir):
    return ranking.win_rates(scores(spark, sf_dir), ["dataset", "metric"]).select("a", "b", R("win_rate"))


@query("r11_rank_matrix", f"WITH {RANKS} SELECT dataset, round(max(mean_rank) FILTER (WHERE model = 'AF'), 6) AS AF, round(max(mean_rank) FILTER (WHERE model = 'RF'), 6) AS RF, round(avg(mean_rank), 6) AS average FROM m WHERE model IN ('AF', 'RF') GROUP BY 1")
def r11(spark, sf_dir):
    return ranking.rank_matrix(ranking.mean_ranks(scores(spark, sf_dir)), ["AF", "RF"]).select("dataset", R("AF"), R("RF"), R("average"))


@query("j09_score_table", f"WITH {SCORES} SELECT dataset, metric, max(value) FILTER (WHERE model = 'AF') AS AF, max(value) FILTER (WHERE model = 'NF') AS NF FROM s GROUP BY 1, 2 HAVING AF IS NOT NULL AND NF IS NOT NULL")
def j09(spark, sf_dir):
    from tabveil.operators.joins import score_table

    return score_table(scores(spark, sf_dir), ["AF", "NF"])


@query("r12_runtimes", "SELECT o_orderpriority, count(*) AS trials, count(*) FILTER (WHERE o_orderstatus = 'F') AS successful, count(*) FILTER (WHERE o_orderstatus = 'P') AS incomplete, round(avg(CASE WHEN o_orderstatus = 'F' THEN (o_custkey % 100) * 86400 END), 4) AS seconds FROM orders GROUP BY 1")
def r12(spark, sf_dir):
    x = table(spark, sf_dir, "orders").withColumn("end", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_interval(days=(F.col("o_custkey") % 100).cast("int"))))
    return ranking.runtime_summary(x, ["o_orderpriority"], "o_orderdate", "end", F.col("o_orderstatus") == "F").withColumn("seconds", F.round("seconds", 4))


@query("r13_consistent", f"WITH {CURVE}, x AS (SELECT * FROM c WHERE NOT (metric = 'A' AND row_number = 3)) SELECT metric, row_number, value FROM x WHERE metric <> 'A'")
def r13(spark, sf_dir):
    return ranking.consistent_metrics(curve(spark, sf_dir).where("NOT (metric = 'A' AND row_number = 3)")).select("metric", "row_number", "value")


@query("r15_composite", f"WITH {CURVE} SELECT row_number, round(avg(CASE WHEN metric = 'A' THEN greatest(least((value - 20000) / 30000, 1), 0) WHEN metric = 'N' THEN greatest(least((value - 30000) / 10000, 1), 0) ELSE 0.5 END), 8) AS score FROM c GROUP BY 1")
def r15(spark, sf_dir):
    ranges = spark.createDataFrame([("A", 20000.0, 50000.0), ("N", 30000.0, 40000.0)], "metric string, low double, high double")
    return ranking.composite(curve(spark, sf_dir), ranges).select("row_number", R("score", 8))


@query("r16_knee", f"WITH {CURVE}, e AS (SELECT metric, min(row_number) AS x0, max(row_number) AS x1, arg_min(value, row_number) AS y0, arg_max(value, row_number) AS y1 FROM c GROUP BY 1), d AS (SELECT metric, row_number, round(abs((value - y0) / (y1 - y0) - (row_number - x0) / (x1 - x0)), 12) AS d FROM c JOIN e USING (metric)) SELECT metric, arg_max(row_number, (d, -row_number)) AS knee FROM d GROUP BY 1")
def r16(spark, sf_dir):
    return ranking.knee(curve(spark, sf_dir), ["metric"], "row_number", "value")


@query("r17_sufficiency_ranks", f"WITH {CURVE}, r AS (SELECT row_number, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS r FROM c) SELECT row_number, round(avg(r), 6) AS mean_rank FROM r GROUP BY 1")
def r17(spark, sf_dir):
    return ranking.sufficiency_ranks(curve(spark, sf_dir)).select("row_number", R("mean_rank"))


#: Published critical values of the studentised range over the root of 2, for 2 to 6 models, at 0.01, 0.05 and 0.10.
CRITICAL = {"cd_1": (2.576, 2.913, 3.113, 3.255, 3.364), "cd_5": (1.960, 2.344, 2.569, 2.728, 2.850), "cd_10": (1.645, 2.052, 2.291, 2.460, 2.589)}


def critical_sql(name):
    return f"{list(CRITICAL[name])}[k - 1] * sqrt(k * (k + 1) / (6 * n))"


@query(
    "r07_critical_differences",
    f"WITH {RANKS}, z AS (SELECT count(DISTINCT model) AS k, count(DISTINCT dataset) AS n FROM m), a AS (SELECT model, avg(mean_rank) AS mean_rank FROM m GROUP BY 1) SELECT x.model AS a, y.model AS b, round(x.mean_rank - y.mean_rank, 6) AS gap, k AS models, n AS blocks, "
    + ", ".join(f"round({critical_sql(c)}, 2) AS {c}" for c in CRITICAL)
    + f", CASE WHEN x.mean_rank = y.mean_rank THEN '0' ELSE repeat(CASE WHEN x.mean_rank > y.mean_rank THEN '+' ELSE '-' END, CASE WHEN abs(x.mean_rank - y.mean_rank) >= {critical_sql('cd_1')} THEN 3 WHEN abs(x.mean_rank - y.mean_rank) >= {critical_sql('cd_5')} THEN 2 ELSE 1 END) END AS mark FROM a x, a y, z WHERE x.model <> y.model",
)
def r07_critical(spark, sf_dir):
    """Gaps of mean ranks over datasets, with models and datasets counted, the critical differences and the marks."""
    x = ranking.rank_gap_report(ranking.mean_ranks(scores(spark, sf_dir)).select("dataset", "model", "mean_rank"))
    return x.select("a", "b", R("gap"), F.col("models").cast("long").alias("models"), F.col("blocks").cast("long").alias("blocks"), *[R(c, 2) for c in CRITICAL], "mark")


POISSON = " + ".join(f"({{u}} >= {p!r})::INTEGER" for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119))


@query(
    "r10_win_rate_errors",
    f"WITH {SCORES}, p AS (SELECT dataset, metric, x.model AS a, y.model AS b, CASE WHEN x.value > y.value THEN 1.0 WHEN x.value = y.value THEN 0.5 ELSE 0 END AS won FROM s x JOIN s y USING (dataset, metric) WHERE x.model <> y.model),"
    + " w AS (SELECT dataset, metric, r, "
    + POISSON.format(u="(CAST('0x' || substr(md5('0:' || r || ':' || dataset || ':' || metric), 1, 8) AS BIGINT) / 4294967296.0)")
    + " AS w FROM (SELECT DISTINCT dataset, metric FROM p), (SELECT unnest(range(1, 201)) AS r)), t AS (SELECT a, b, r, sum(w * won) / nullif(sum(w), 0) AS m FROM p JOIN w USING (dataset, metric) GROUP BY 1, 2, 3)"
    " SELECT a, b, round(rate, 6) AS win_rate, round(se, 6) AS se FROM (SELECT a, b, avg(won) AS rate FROM p GROUP BY 1, 2) JOIN (SELECT a, b, stddev_pop(m) AS se FROM t GROUP BY 1, 2) USING (a, b)",
)
def r10_errors(spark, sf_dir):
    return ranking.win_rates_with_error(scores(spark, sf_dir), ["dataset", "metric"], 200).select("a", "b", R("win_rate"), R("se"))


@query("r14_threshold_scores", f"WITH {CURVE} SELECT row_number, metric, value, round(CASE WHEN metric = 'A' THEN greatest(least((value - 20000) / 30000, 1), 0) WHEN metric = 'N' THEN greatest(least((value - 25000) / 200, 1), 0) ELSE 0.5 END, 8) AS score FROM c")
def r14(spark, sf_dir):
    ranges = spark.createDataFrame([("A", 20000.0, 50000.0), ("N", 25000.0, 25200.0)], "metric string, low double, high double")
    return ranking.threshold_scores(curve(spark, sf_dir), ranges).select("row_number", "metric", "value", R("score", 8))
