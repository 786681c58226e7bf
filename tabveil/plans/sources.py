"""Queries that write tables to the shared folder and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabveil.operators import replicates
from tabveil.plans.distances import rounded
from tabveil.registry import query, table
from tabveil.session import shared_dir
from tabveil.sources import tables


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_s05_tsv", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def s01(spark, sf_dir):
    path = folder(spark, "tsv")
    tables.write_table(table(spark, sf_dir, "customer"), path)
    x = tables.read_table(spark, path, "tsv", drop_columns=["c_name", "c_nationkey", "other"])
    return x.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("s02_headerless", "SELECT n_nationkey, n_name FROM nation")
def s02(spark, sf_dir):
    path = folder(spark, "text")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(path)
    return tables.read_table(spark, path, schema="n_nationkey int, n_name string")


@query("s03_lenient", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 > 0")
def s03(spark, sf_dir):
    path = folder(spark, "ragged")
    line = F.when(F.col("o_orderkey") % 10 == 0, F.concat_ws("\t", F.lit("x"), "o_orderkey")).otherwise(F.concat_ws("\t", "o_orderkey", "o_orderkey", "o_orderstatus"))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return tables.read_lenient(spark, path, "`Unnamed: 0` long, o_orderkey long, o_orderstatus string", header=False)


@query("s06_cohorts", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def s06(spark, sf_dir):
    path = folder(spark, "cohorts")
    tables.write_cohorts(table(spark, sf_dir, "customer"), "c_mktsegment", path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("s07_value_counts", "SELECT 'l_returnflag' AS column, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def s07(spark, sf_dir):
    return tables.value_counts(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey"), ("key",))


@query("s08_check", "SELECT unnest(['continuous column nothing doesn''t exist', 'constraint o_totalprice >< 3 can''t be read', 'delta isn''t below one over the number of rows']) AS issue FROM (SELECT count(*) AS n FROM orders) WHERE n > 0")
def s08(spark, sf_dir):
    spec = tables.Spec(["o_totalprice", "nothing"], target="o_orderstatus", constraints=["o_totalprice > 3", "o_totalprice >< 3"], delta=0.5)
    return spark.createDataFrame([(x,) for x in tables.check_spec(table(spark, sf_dir, "orders"), spec)], "issue string")


@query("s09_scores", "SELECT l_returnflag AS model, 'm' || l_linenumber AS metric, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1, 2")
def s09(spark, sf_dir):
    path = folder(spark, "trials")
    x = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.concat(F.lit("m"), "l_linenumber").alias("metric")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    x.write.partitionBy("l_returnflag").options(header=True).csv(path)
    return tables.collect_scores(spark, f"{path}/*/*.csv", "l_returnflag=([^/]+)/", ["model"]).withColumn("value", F.round("value", 6)).select("model", "metric", "value")


DISCRETE, CONTINUOUS = ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"]


def scores_sql(real, synthetic, rounds, drawn):
    """sample, value, covered of hash samples (r) of the synthetic orders."""
    classes = lambda t, extra: " UNION ALL ".join(f"SELECT {extra} '{c}' AS c, {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL" for c in DISCRETE)
    return f"""a AS ({real}), s AS (SELECT r, x.* FROM ({synthetic}) x, (SELECT unnest(range({rounds})) AS r) WHERE {drawn}),
    p AS (SELECT c, v, n / sum(n) OVER (PARTITION BY c) AS p FROM ({classes('a', '')})), q AS (SELECT r, c, v, n / sum(n) OVER (PARTITION BY r, c) AS q FROM ({classes('s', 'r,')})),
    d AS (SELECT r, c, avg(abs(p - coalesce(q, 0)) / sqrt(2)) AS d FROM p JOIN (SELECT unnest(range({rounds})) AS r) ON true LEFT JOIN q USING (r, c, v) GROUP BY ALL),
    k AS (SELECT r, bool_and(n = (SELECT count(*) FROM p WHERE p.c = z.c)) AS covered FROM (SELECT r, c, count(*) AS n FROM q GROUP BY ALL) z GROUP BY 1),
    f AS (SELECT r, 2 * abs((SELECT corr(o_totalprice, o_custkey) FROM a) - corr(o_totalprice, o_custkey)) / 4 AS f FROM s GROUP BY 1),
    o AS (SELECT CAST(r AS INTEGER) AS sample, f + 10 * (SELECT avg(d) FROM d WHERE d.r = f.r) AS value, covered FROM f JOIN k USING (r))"""


@query(
    "n13_best_sample",
    "WITH " + scores_sql("SELECT * FROM orders WHERE o_orderkey % 10 >= 2 AND o_orderkey % 2 = 0", "SELECT * FROM orders WHERE o_orderkey % 10 >= 2 AND o_orderkey % 2 = 1", 4, "CAST('0x' || substr(md5(r || ':' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.3") + " SELECT arg_min(sample, value) AS sample, round(min(value), 6) AS value FROM o WHERE covered",
)
def n13(spark, sf_dir):
    """The hash sample of synthetic orders that is nearest to the real ones, of those that cover all classes."""
    from tabveil.plans.prepare import real, synthetic

    samples = replicates.unit_lists(synthetic(spark, sf_dir), "o_orderkey", 4, 0.3)
    return rounded(replicates.best_sample(replicates.sample_scores(real(spark, sf_dir), samples, 4, DISCRETE, CONTINUOUS)))


@query(
    "n13_sample_scores",
    "WITH " + scores_sql("SELECT * FROM orders WHERE o_orderkey % 2 = 0", "SELECT * FROM orders WHERE o_orderkey % 2 = 1", 200, "CAST('0x' || substr(md5('0:' || (r // 4) || ':' || o_orderkey), 8 * (r % 4) + 1, 8) AS BIGINT) < 1288490188") + " SELECT sample, round(value, 9) AS value, covered, sample = (SELECT arg_min(sample, value) FROM o WHERE covered) AS best FROM o",
)
def n13_scores(spark, sf_dir):
    """200 samples of all synthetic orders from one scan, and which of those that cover all classes is the best."""
    x = table(spark, sf_dir, "orders")
    samples = replicates.replicate_lists(x.where("o_orderkey % 2 = 1"), "o_orderkey", 200, 0.3)
    scores = replicates.sample_scores(x.where("o_orderkey % 2 = 0"), samples, 200, DISCRETE, CONTINUOUS)
    best = replicates.best_sample(scores).select(F.col("sample").alias("_best"))
    return scores.crossJoin(F.broadcast(best)).select("sample", F.round("value", 9).alias("value"), "covered", F.coalesce(F.col("sample") == F.col("_best"), F.lit(False)).alias("best"))  # one row
