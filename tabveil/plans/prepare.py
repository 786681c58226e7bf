"""Queries over cleaning functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil import functions as C
from tabveil.operators import filters
from tabveil.registry import query, table


def real(spark, sf_dir):
    """Half of the orders outside the hold-out."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 10 >= 2 AND o_orderkey % 2 = 0")


def synthetic(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 10 >= 2 AND o_orderkey % 2 = 1")


REAL = "(SELECT * FROM orders WHERE o_orderkey % 10 >= 2 AND o_orderkey % 2 = 0)"
SYNTHETIC = "(SELECT * FROM orders WHERE o_orderkey % 10 >= 2 AND o_orderkey % 2 = 1)"


@query(
    "p01_sentinels",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN ' TAG' WHEN p_partkey % 5 = 0 THEN '-1' ELSE p_brand END AS v FROM part)
    SELECT CASE WHEN lower(trim(v)) NOT IN ('tag', '?', '-1', '-1.0', '-9999999', 'empty') THEN v END AS v, count(*) AS n,
      count(*) FILTER (WHERE lower(trim(v)) IN ('tag', '?', '-1', '-1.0', '-9999999', 'empty')) AS replaced FROM x GROUP BY 1""",
)
def p01(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 == 0, " TAG").when(F.col("p_partkey") % 5 == 0, "-1").otherwise(F.col("p_brand")).alias("v"))
    return x.groupBy(C.clean_sentinels(F.col("v")).alias("v")).agg(F.count("*").alias("n"), F.count_if(C.is_sentinel(F.col("v"))).alias("replaced"))


@query("p02_normalise", "SELECT lower(trim(c_mktsegment)) AS segment, count(*) AS n FROM customer GROUP BY 1")
def p02(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(C.normalise_text(F.col("c_mktsegment")).alias("segment")).agg(F.count("*").alias("n"))


@query("p03_by_substring", "SELECT CASE WHEN contains(o_orderpriority, '1') THEN 'first' WHEN contains(o_orderpriority, 'LOW') THEN 'last' ELSE o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY 1")
def p03(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(C.by_substring(F.col("o_orderpriority"), [("1", "first"), ("LOW", "last")]).alias("priority")).agg(F.count("*").alias("n"))


@query(
    "p04_year_difference",
    "SELECT year(l_shipdate) - year(o_orderdate) AS years, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def p04(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy(C.year_difference(F.col("l_shipdate"), F.col("o_orderdate")).alias("years")).agg(F.count("*").alias("n"))


@query("p05_first_known", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, o_orderpriority) AS v FROM orders")
def p05(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")), "o_orderpriority").alias("v"))


@query("p06_year_bin", "SELECT CAST((year(o_orderdate) - 1) // 5 * 5 AS INTEGER) AS edge, count(*) AS n FROM orders GROUP BY 1")
def p06(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(C.year_bin(F.col("o_orderdate")).alias("edge")).agg(F.count("*").alias("n"))


@query("p07_span_bin", "SELECT CASE WHEN v > 0 AND v <= 195 THEN CAST(ceil(v / 5) * 5 - 5 AS INTEGER) END AS edge, count(*) AS n FROM (SELECT l_quantity - 3 AS v FROM lineitem) GROUP BY 1")
def p07(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(C.span_bin(F.col("l_quantity") - 3).alias("edge")).agg(F.count("*").alias("n"))


@query("p08_bin_edge", "SELECT p_size, CAST(p_size AS DOUBLE) AS edge, count(*) AS n FROM part GROUP BY 1, 2")
def p08(spark, sf_dir):
    label = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") + 5).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "part").groupBy("p_size", C.bin_left_edge(label).alias("edge")).agg(F.count("*").alias("n"))


@query("p09_presence", "SELECT o_orderstatus, sum(CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END)::BIGINT AS present FROM orders GROUP BY 1")
def p09(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sum(C.presence(F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")))).alias("present"))


@query("p10_days", "SELECT o_orderkey, CAST(date_diff('day', DATE '1800-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS back FROM orders")
def p10(spark, sf_dir):
    days = C.date_to_days(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.alias("days"), C.days_to_date(days).cast("string").alias("back"))


@query("p11_date_parts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def p11(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d")).agg(F.count("*").alias("n"))


@query("p13_ratio", "SELECT p_partkey, round_even(p_retailprice / ((p_size / 100.0) * (p_size / 100.0)), 2) AS v FROM part")
def p13(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(C.bmi(F.col("p_retailprice"), F.col("p_size")), 2).alias("v"))


@query("p16_clip", "SELECT l_orderkey, l_linenumber, greatest(least(l_extendedprice, (SELECT max(o_totalprice) / 20 FROM orders)), (SELECT min(o_totalprice) FROM orders)) AS v FROM lineitem")
def p16(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").agg(F.min("o_totalprice").alias("lo"), (F.max("o_totalprice") / 20).alias("hi"))
    return table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(ends)).select("l_orderkey", "l_linenumber", C.clip(F.col("l_extendedprice"), F.col("lo"), F.col("hi")).alias("v"))  # ends is one row


@query(
    "p17_shifted_log",
    """WITH s AS (SELECT min(c_acctbal) AS lo FROM customer) SELECT c_custkey, round(CASE WHEN lo > 0 THEN ln(c_acctbal) WHEN lo = 0 THEN ln(c_acctbal + 1) ELSE ln(c_acctbal - lo + 1) END, 8) AS v,
    round(c_acctbal, 4) AS back FROM customer, s""",
)
def p17(spark, sf_dir):
    x = table(spark, sf_dir, "customer")
    x = x.crossJoin(F.broadcast(x.agg(F.min("c_acctbal").alias("lo"))))  # one row
    v = C.shifted_log(F.col("c_acctbal"), F.col("lo"))
    return x.select("c_custkey", F.round(v, 8).alias("v"), F.round(C.shifted_exp(v, F.col("lo")), 4).alias("back"))


@query("p18_rounded", "SELECT CAST(round(l_extendedprice) AS INTEGER) AS v, count(*) AS n FROM lineitem GROUP BY 1")
def p18(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.round("l_extendedprice").cast("int").alias("v")).agg(F.count("*").alias("n"))


@query("p19_first_maximum", "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END::BIGINT AS code, count(*) AS n FROM lineitem GROUP BY 1, 2")
def p19(spark, sf_dir):
    flags = [(F.col("l_returnflag") == v).cast("int") for v in "ANR"]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", C.first_maximum(*flags).alias("code")).agg(F.count("*").alias("n"))


@query("p22_parse_pairs", "SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def p22(spark, sf_dir):
    text = F.concat(F.lit("segment is "), F.col("c_mktsegment"), F.lit(", nation is "), F.col("c_nationkey").cast("string"), F.lit(", segment is other"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.parse_pairs(text, ["segment", "nation"]).alias("x")).select("c_custkey", "x.segment", "x.nation")


@query("f01_cohort", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def f01(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


RULES = ["l_quantity > 5", "l_discount < 0.08", "l_tax <= 0.06 OR l_returnflag = 'N'"]


@query(
    "f02_constraint_report",
    """SELECT rule, count(*) FILTER (WHERE k = n) AS dropped FROM (SELECT CASE WHEN NOT l_quantity > 5 THEN 0 WHEN NOT l_discount < 0.08 THEN 1 WHEN NOT (l_tax <= 0.06 OR l_returnflag = 'N') THEN 2 END AS k FROM lineitem),
    (VALUES (0, 'l_quantity > 5'), (1, 'l_discount < 0.08'), (2, 'l_tax <= 0.06 OR l_returnflag = ''N''')) r(n, rule) GROUP BY rule""",
)
def f02(spark, sf_dir):
    return filters.constraint_report(table(spark, sf_dir, "lineitem"), RULES)


@query("f02_constrained", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity > 5 AND l_discount < 0.08 AND (l_tax <= 0.06 OR l_returnflag = 'N') GROUP BY 1")
def f02b(spark, sf_dir):
    return filters.constrain(table(spark, sf_dir, "lineitem"), RULES).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "f03_top_up",
    """WITH p AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000), v AS (SELECT o_orderkey, o_totalprice FROM p WHERE o_totalprice > 150000 ORDER BY o_orderkey LIMIT 100)
    SELECT *, 100 - (SELECT count(*) FROM v) AS shortfall FROM v""",
)
def f03(spark, sf_dir):
    return filters.top_up(table(spark, sf_dir, "orders"), ["o_totalprice > 150000"], 100, [F.col("o_orderkey")]).select("o_orderkey", "o_totalprice", "shortfall")


@query(
    "f03_top_up_to_the_end",
    """WITH v AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderkey > (SELECT 0.999 * max(o_orderkey) FROM orders) ORDER BY o_orderkey LIMIT 100)
    SELECT *, 100 - (SELECT count(*) FROM v) AS shortfall FROM v""",
)
def f03_end(spark, sf_dir):
    """Valid orders lie at the end of the table, and are fewer than asked for or just enough."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg((0.999 * F.max("o_orderkey")).alias("last"))
    pool = orders.crossJoin(F.broadcast(last))  # one row
    return filters.top_up(pool, ["o_totalprice > 150000", "o_orderkey > last"], 100, [F.col("o_orderkey")], most=100).select("o_orderkey", "o_totalprice", "shortfall")


@query("f04_match", "SELECT l_orderkey, l_linenumber, l_returnflag, 20.0::DOUBLE AS l_quantity FROM lineitem WHERE abs(l_quantity - 20) <= 20 * 0.1 AND l_returnflag = 'A'")
def f04(spark, sf_dir):
    return filters.match_conditions(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), {"l_quantity": 20.0, "l_returnflag": "A"}, 0.1)


@query(
    "f05_small_cells",
    """WITH a AS (SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 25)),
    b AS (SELECT * FROM a WHERE l_suppkey IN (SELECT l_suppkey FROM a GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 25)) SELECT l_suppkey, count(*) AS n FROM b GROUP BY 1""",
)
def f05(spark, sf_dir):
    return filters.drop_small_cells(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], "l_orderkey", 25).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("f06_rare_rows", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def f06(spark, sf_dir):
    return filters.drop_rare_rows(table(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey", 30).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query(
    "f07_unique_codes",
    """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS code FROM orders), l AS (SELECT code FROM o GROUP BY 1 HAVING count(DISTINCT o_custkey) = 1),
    w AS (SELECT o_custkey, bool_or(code IN (SELECT code FROM l)) AS own, count(*) > 1 AS several FROM o GROUP BY 1)
    SELECT o_custkey, CAST(code AS VARCHAR) AS code FROM o WHERE o_custkey IN (SELECT o_custkey FROM w WHERE own <> several)""",
)
def f07(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("code"))
    return filters.unique_code_rows(x, "o_custkey", "code").select("o_custkey", F.col("code").cast("string").alias("code"))


@query("f08_copies", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem")
def f08(spark, sf_dir):
    return filters.drop_copies(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax"))


@query("f09_all_repeated", "SELECT l_partkey, l_quantity FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def f09(spark, sf_dir):
    return filters.drop_all_repeated(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"))


@query("f10_leaks", f"SELECT DISTINCT o_custkey, o_orderstatus FROM {SYNTHETIC} EXCEPT SELECT o_custkey, o_orderstatus FROM {REAL}")
def f10(spark, sf_dir):
    columns = ["o_custkey", "o_orderstatus"]
    return filters.drop_leaks(synthetic(spark, sf_dir).select(columns), real(spark, sf_dir).select(columns))


@query(
    "f11_rare_folded",
    f"""WITH k AS (SELECT o_custkey FROM {REAL} GROUP BY 1 HAVING count(*) >= round_even((SELECT count(*) FROM {REAL}) * 0.001, 0))
    SELECT CASE WHEN o_custkey IN (SELECT o_custkey FROM k) THEN CAST(o_custkey AS VARCHAR) ELSE '_rare_' END AS customer, count(*) AS n FROM {SYNTHETIC} GROUP BY 1""",
)
def f11(spark, sf_dir):
    a, b = (d.select(F.col("o_custkey").cast("string").alias("customer")) for d in (synthetic(spark, sf_dir), real(spark, sf_dir)))
    return filters.fold_rare(a, b, "customer", 0.001).groupBy("customer").agg(F.count("*").alias("n"))


@query("f12_common_classes", f"SELECT o_custkey, count(*) AS n FROM {REAL} WHERE o_custkey IN (SELECT o_custkey FROM {SYNTHETIC}) GROUP BY 1")
def f12(spark, sf_dir):
    return filters.common_classes(real(spark, sf_dir), synthetic(spark, sf_dir), "o_custkey")[0].groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("f13_complete_rows", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1")
def f13(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"))
    return x.na.drop("any").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "f14_coverage",
    f"""SELECT *, n_real = n_sample AS covered FROM (SELECT 'o_orderstatus' AS column, (SELECT count(DISTINCT o_orderstatus) FROM {REAL}) AS n_real, (SELECT count(DISTINCT o_orderstatus) FROM {SYNTHETIC}) AS n_sample
    UNION ALL SELECT 'o_custkey', (SELECT count(DISTINCT o_custkey) FROM {REAL}), (SELECT count(DISTINCT o_custkey) FROM {SYNTHETIC}))""",
)
def f14(spark, sf_dir):
    return filters.class_coverage(*(d.select("o_orderstatus", F.col("o_custkey").cast("string").alias("o_custkey")) for d in (real(spark, sf_dir), synthetic(spark, sf_dir))), ["o_orderstatus", "o_custkey"])


@query("f15_out_of_range", f"SELECT (o_totalprice < (SELECT min(o_totalprice) FROM {REAL}) OR o_totalprice > (SELECT max(o_totalprice) FROM {REAL})) AS out_of_range, count(*) AS n FROM {SYNTHETIC} GROUP BY 1")
def f15(spark, sf_dir):
    return filters.out_of_range(synthetic(spark, sf_dir), real(spark, sf_dir), ["o_totalprice"]).groupBy("out_of_range").agg(F.count("*").alias("n"))
