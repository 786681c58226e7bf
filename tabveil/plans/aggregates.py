"""Queries over codes, joins, counts, profiles and groupings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil.operators import aggregates, codes, joins, neighbours
from tabveil.plans.prepare import REAL, SYNTHETIC, real, synthetic
from tabveil.registry import query, table


@query("p12_cast_roles", "SELECT CAST(p_size AS DOUBLE) AS p_size, p_brand, count(*) AS n FROM part GROUP BY 1, 2")
def p12(spark, sf_dir):
    x = codes.cast_roles(table(spark, sf_dir, "part").select("p_size", "p_brand", F.lit(1).alias("diagnosis")), ["p_size"])
    return x.groupBy(*x.columns).agg(F.count("*").alias("n"))


@query("p14_align", "SELECT p_brand, CAST(NULL AS DOUBLE) AS extra, CAST(p_size AS BIGINT) AS p_size, count(*) AS n FROM part GROUP BY 1, 3")
def p14(spark, sf_dir):
    from pyspark.sql.types import StructType

    x = codes.align(table(spark, sf_dir, "part"), StructType.fromDDL("p_brand string, extra double, p_size long"))
    return x.groupBy(*x.columns).agg(F.count("*").alias("n"))


@query(
    "p15_snapped",
    """WITH v AS (SELECT DISTINCT l_discount AS v FROM lineitem WHERE l_discount < 0.06), d AS (SELECT DISTINCT l_discount FROM lineitem),
    m AS (SELECT l_discount, arg_min(v, (round(abs(l_discount - v), 9), v)) AS snapped FROM d, v GROUP BY 1) SELECT l_discount, snapped, count(*) AS n FROM lineitem JOIN m USING (l_discount) GROUP BY 1, 2""",
)
def p15(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_discount", F.col("l_discount").alias("snapped"))
    seen = table(spark, sf_dir, "lineitem").where("l_discount < 0.06").select(F.col("l_discount").alias("snapped"))
    return codes.snap_to_seen(x, seen, "snapped").groupBy("l_discount", "snapped").agg(F.count("*").alias("n"))


@query("p20_category_codes", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS c_name FROM customer")
def p20(spark, sf_dir):
    return codes.pseudonymise_categories(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")


@query("p21_person_pseudonyms", "SELECT o_custkey, 'id' || lpad(CAST(row_number() OVER (ORDER BY substr(md5('0:' || o_custkey), 1, 8), o_custkey) AS VARCHAR), 6, '0') AS pseudonym FROM (SELECT DISTINCT o_custkey FROM orders)")
def p21(spark, sf_dir):
    return codes.person_pseudonyms(table(spark, sf_dir, "orders"), "o_custkey")


@query("j01_registries", "SELECT k, o, c, s FROM (SELECT o_custkey AS k, count(*) AS o FROM orders GROUP BY 1) FULL JOIN (SELECT c_custkey AS k, c_acctbal AS c FROM customer WHERE c_custkey % 3 > 0) USING (k) FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS s FROM supplier) USING (k)")
def j01(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("o"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("c"))
    return joins.join_registries("k", o, c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("s")))


@query("j02_left", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY 1")
def j02(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", "c_nationkey")
    return table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


@query("j03_through_map", "SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j03(spark, sf_dir):
    mapping = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    x = joins.join_through(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), mapping, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "l_orderkey", "c_custkey")
    return x.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("j04_overlap", f"SELECT o_custkey, o_orderpriority FROM {REAL} INTERSECT SELECT o_custkey, o_orderpriority FROM {SYNTHETIC}")
def j04(spark, sf_dir):
    return joins.row_overlap(real(spark, sf_dir), synthetic(spark, sf_dir), ["o_custkey", "o_orderpriority"])


@query("j05_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j05(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("j06_semi", f"SELECT o_orderkey FROM {REAL} WHERE o_custkey IN (SELECT o_custkey FROM {SYNTHETIC})")
def j06(spark, sf_dir):
    return joins.rows_in(real(spark, sf_dir), synthetic(spark, sf_dir), ["o_custkey"]).select("o_orderkey")


def shares_sql(real, synthetic, *columns):
    """SQL of a table `j` like paired_shares."""
    long = lambda source, n, p: " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS {n}, count(*) / (SELECT count({c}) FROM {source}) AS {p} FROM {source} WHERE {c} IS NOT NULL GROUP BY 2" for c in columns)
    return f"j AS (SELECT col, value, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM ({long(real, 'n', 'p')}) FULL JOIN ({long(synthetic, 'm', 'q')}) USING (col, value))"


@query("j07_paired_shares", f"WITH {shares_sql(REAL, SYNTHETIC, 'o_orderstatus', 'o_orderpriority')} SELECT col AS column, value, n, m, round(p, 9) AS p, round(q, 9) AS q FROM j")
def j07(spark, sf_dir):
    x = joins.paired_shares(real(spark, sf_dir), synthetic(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])
    return x.withColumns({c: F.round(c, 9) for c in "pq"})


@query("j08_nearest", "WITH d AS (SELECT s_suppkey AS id, c_custkey AS other, abs(s_acctbal - c_acctbal) + abs(s_nationkey - c_nationkey) AS d FROM supplier, customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM d) SELECT id, CAST(rank AS INTEGER) AS rank, other, round(d, 6) AS distance FROM r WHERE rank <= 3")
def j08(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("n"))
    return neighbours.k_nearest(s, c, ["a", "n"], 3, "l1").withColumn("distance", F.round("distance", 6))


@query(
    "a01_visit_history",
    """WITH r AS (SELECT o_custkey, o_totalprice, o_orderstatus, 6 - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS slot, count(*) OVER (PARTITION BY o_custkey) AS n,
      first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
    SELECT o_custkey, n AS n_events, p AS o_orderpriority, """ + ", ".join(f"max(o_totalprice) FILTER (WHERE slot = {s}) AS o_totalprice_{s}" for s in range(1, 6)) + " FROM r GROUP BY 1, 2, 3",
)
def a01(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")
    return aggregates.visit_history(x, "o_custkey", "o_orderdate", "o_orderkey", ["o_totalprice"], ["o_orderpriority"])


@query("a02_exact_labels", "SELECT CASE WHEN p_brand IN ('Brand#13', 'Brand#14') THEN 'b' WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'a' END AS label, count(*) AS n FROM part GROUP BY 1")
def a02(spark, sf_dir):
    rules = [("a", ["Brand#11", "Brand#12", "Brand#13"]), ("b", ["Brand#13", "Brand#14"])]
    return aggregates.label_by_code(table(spark, sf_dir, "part"), "p_brand", rules).groupBy("label").agg(F.count("*").alias("n"))


@query("a03_prefix_labels", "SELECT CASE WHEN substr(p_type, 1, 3) IN ('ECO', 'PRO') THEN 'cheap' WHEN substr(p_type, 1, 3) IN ('STA') THEN 'plain' END AS label, count(*) AS n FROM part GROUP BY 1")
def a03(spark, sf_dir):
    return aggregates.label_by_code(table(spark, sf_dir, "part"), "p_type", [("plain", ["STA"]), ("cheap", ["ECO", "PRO"])], 3).groupBy("label").agg(F.count("*").alias("n"))


@query("a04_unlabelled", "SELECT DISTINCT p_brand FROM part WHERE NOT (p_brand IN ('Brand#11', 'Brand#12') OR substr(p_brand, 1, 7) = 'Brand#2')")
def a04(spark, sf_dir):
    x = aggregates.label_by_code(table(spark, sf_dir, "part"), "p_brand", [("a", ["Brand#11", "Brand#12"])]).withColumnRenamed("label", "one")
    x = aggregates.label_by_code(x, "p_brand", [("c", ["Brand#2"])], 7)
    return aggregates.unlabelled(x.withColumn("label", aggregates.combine_labels(F.col("one"), F.col("label"))), "p_brand")


@query("a05_cohort_flags", "SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS is_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS is_MACHINERY FROM customer")
def a05(spark, sf_dir):
    return aggregates.cohort_flags(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "is_BUILDING", "is_MACHINERY")


@query("a06_persons_per_pair", "SELECT l_returnflag, l_suppkey, count(DISTINCT l_orderkey) AS persons FROM lineitem GROUP BY 1, 2")
def a06(spark, sf_dir):
    return aggregates.persons_per_pair(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "l_orderkey")


@query("a07_missing", "SELECT 'o_custkey' AS column, 0.0::DOUBLE AS missing UNION ALL SELECT 'v', round(avg(CASE WHEN o_orderkey % 7 = 0 THEN 100.0 ELSE 0 END), 6) FROM orders")
def a07(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))
    return aggregates.missing_percentages(x).withColumn("missing", F.round("missing", 6))


STATS = "count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, CAST(min({0}) AS DOUBLE) AS min, round(quantile_cont({0}, 0.25), 6) AS q1, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.75), 6) AS q3, CAST(max({0}) AS DOUBLE) AS max"


@query("a08_profile", " UNION ALL ".join(f"SELECT '{c}' AS column, {STATS.format(c)} FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def a08(spark, sf_dir):
    x = aggregates.profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return x.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q1", "median", "q3")})


@query("a09_side_by_side", " UNION ALL ".join(f"SELECT '{n}' AS source, 'o_totalprice' AS column, round(avg(o_totalprice), 5) AS mean, round(stddev_samp(o_totalprice), 5) AS std FROM {t}" for n, t in (("real", REAL), ("synthetic", SYNTHETIC))))
def a09(spark, sf_dir):
    x = aggregates.side_by_side({"real": real(spark, sf_dir), "synthetic": synthetic(spark, sf_dir)}, ["o_totalprice"])
    return x.withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query("a10_histogram", "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT 'o_totalprice' AS column, CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 2")
def a10(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "orders"), ["o_totalprice"]).withColumn("bin", F.col("bin").cast("long"))


@query("a11_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem")
def a11(spark, sf_dir):
    return aggregates.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("r", F.round("r", 6))


@query("a12_grouped_quartiles", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1, 2")
def a12(spark, sf_dir):
    return aggregates.grouped_quartiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("a13_format_conflicts", "WITH x AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS v FROM customer) SELECT 'v' AS column, count(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL) AS numeric, count(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NULL) AS textual, array_to_string(list_sort(list_distinct(list(v) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL)))[1:3], '|') AS numbers, array_to_string(list_sort(list_distinct(list(v) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NULL)))[1:3], '|') AS texts FROM x")
def a13(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string")).alias("v"))
    return aggregates.format_conflicts(x, ["v"]).withColumns({c: F.array_join(c, "|") for c in ("numbers", "texts")})


@query("a14_types", "SELECT * FROM (VALUES ('o_orderdate', 'date'), ('o_totalprice', 'numeric'), ('o_orderpriority', 'string'), ('mix', 'mixed'), ('none', 'null')) t(\"column\", type)")
def a14(spark, sf_dir):
    x = table(spark, sf_dir, "orders").withColumn("mix", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string"))).withColumn("none", F.lit(None).cast("string"))
    return aggregates.infer_types(x, ["o_orderdate", "o_totalprice", "o_orderpriority", "mix", "none"])


@query("a15_roles", "SELECT 'l_returnflag' AS column, count(DISTINCT l_returnflag) AS distinct, 'discrete' AS role FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), 'binary' FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), 'continuous' FROM lineitem")
def a15(spark, sf_dir):
    return aggregates.infer_roles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey"])


@query("a16_suppressed_counts", "SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) >= 10 THEN count(*) END AS n FROM customer GROUP BY c_nationkey, c_mktsegment")
def a16(spark, sf_dir):
    return aggregates.suppressed_counts(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("a17_roll_up", "SELECT substr(p_type, 1, 1) AS chapter, substr(p_type, 1, 3) AS block, p_type AS code, CASE WHEN count(*) >= 10 THEN count(*) END AS n, 3 - grouping(chapter) - grouping(block) - grouping(code) AS depth FROM (SELECT *, substr(p_type, 1, 1) AS chapter, substr(p_type, 1, 3) AS block, p_type AS code FROM part) GROUP BY ROLLUP (chapter, block, code)".replace("substr(p_type, 1, 1) AS chapter, substr(p_type, 1, 3) AS block, p_type AS code, CASE", "chapter, block, code, CASE", 1))
def a17(spark, sf_dir):
    code = F.col("p_type")
    return aggregates.roll_up(table(spark, sf_dir, "part"), {"chapter": F.substring(code, 1, 1), "block": F.substring(code, 1, 3), "code": code})


@query("a18_cube", "SELECT l_returnflag, l_linestatus, l_linenumber, CASE WHEN count(*) >= 10 THEN count(*) END AS n, CAST(grouping(l_returnflag, l_linestatus, l_linenumber) AS INTEGER) AS grouping FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def a18(spark, sf_dir):
    return aggregates.stratify(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
