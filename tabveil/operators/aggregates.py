"""Histories, labels, profiles, histograms, suppressed and stratified counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.operators.codes import quantiles


def visit_history(df: DataFrame, person: str, date: str, tie: str, measures: list[str], constants: list[str], slots: int = 5) -> DataFrame:
    """One row a person: the last `slots` visits right-aligned (slot `slots` is the last), n_events, and the first known constants.

    Visits without a date count as the latest; ties go by the tie column. A window over one person's visits.
    """
    order = Window.partitionBy(person).orderBy(F.desc_nulls_first(date), F.desc(tie))
    x = df.withColumn("_slot", slots + 1 - F.row_number().over(order))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(date).isNull(), F.col(date), F.col(tie))))
    cells = [F.max(F.when(F.col("_slot") == s, F.col(m))).alias(f"{m}_{s}") for s in range(1, slots + 1) for m in measures]
    return x.groupBy(person).agg(F.count("*").alias("n_events"), *[first(c).alias(c) for c in constants], *cells)


def label_by_code(df: DataFrame, code: str, rules: list[tuple[str, list[str]]], prefix: int | None = None) -> DataFrame:
    """df with label: that of the last rule whose list holds the code (or its first `prefix` characters)."""
    c = F.col(code) if prefix is None else F.substring(code, 1, prefix)
    label = reduce(lambda old, rule: F.when(c.isin(*rule[1]), rule[0]).otherwise(old), rules, F.lit(None).cast("string"))
    return df.withColumn("label", label)


def combine_labels(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def unlabelled(df: DataFrame, code: str, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNull() & F.col(code).isNotNull()).select(code).distinct()


def cohort_flags(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"is_{v}": (F.col(column) == v).cast("int") for v in values})


def persons_per_pair(df: DataFrame, a: str, b: str, person: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count_distinct(person).alias("persons"))


def missing_percentages(df: DataFrame) -> DataFrame:
    """column, missing: percentage of NULLs of each column, in one pass."""
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "missing")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std, min, q1, median, q3, max of numeric columns, exact; quartiles by ranks in range partitions."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v")
    x = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(long, ["column"], "v", [0.25, 0.5, 0.75]).select("_g.column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    return x.join(q, "column", "left").select("column", "n", "mean", "std", "min", "q1", "median", "q3", "max")


def side_by_side(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """source, column, mean, std of several tables."""
    long = [d.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v").withColumn("source", F.lit(s)) for s, d in tables.items()]
    return reduce(DataFrame.unionByName, long).groupBy("source", "column").agg(F.avg("v").alias("mean"), F.stddev("v").alias("std"))


def histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """column, bin (from 0), n: equal-width bins between each column's least and largest value, the last one closed."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    x = df.select([F.col(c).cast("double").alias(c) for c in columns]).crossJoin(F.broadcast(ends))  # one row
    number = lambda c: F.least(F.floor(F.try_divide(F.col(c) - F.col(f"lo_{c}"), (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bins)), F.lit(bins - 1))
    x = x.select([F.when(F.col(c).isNotNull(), F.coalesce(number(c), F.lit(0))).alias(c) for c in columns])
    return x.unpivot([], columns, "column", "bin").where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in pairs]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def grouped_quartiles(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """keys, n, q1, median, q3 of the known measures of each group; a group without any has NULL quartiles."""
    x = df.groupBy(F.struct(F.lit(0).alias("_all"), *keys).alias("_g")).agg(F.count(measure).alias("n")).join(quantiles(df, keys, measure, [0.25, 0.5, 0.75]), "_g", "left")
    return x.select(*[F.col("_g")[k].alias(k) for k in keys], "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def format_conflicts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, numeric, textual and up to three (smallest) samples of each."""
    x = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "v").where("v IS NOT NULL")
    x = x.groupBy("column", "v").agg(F.count("*").alias("n")).withColumn("is_number", F.col("v").try_cast("double").isNotNull())
    nth = F.row_number().over(Window.partitionBy("column", "is_number").orderBy("v"))
    sample = x.withColumn("nth", nth).where("nth <= 3").groupBy("column").agg(*[F.array_sort(F.collect_list(F.when(F.col("is_number") == flag, F.col("v")))).alias(name) for name, flag in (("numbers", True), ("texts", False))])
    counts = x.groupBy("column").agg(*[F.sum(F.when(F.col("is_number") == flag, F.col("n")).otherwise(0)).alias(name) for name, flag in (("numeric", True), ("textual", False))])
    return counts.join(sample, "column")


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, type: date, numeric, string, mixed or null, by what its known values can be read as."""
    known = lambda c: F.count(c)
    def of(c: str) -> Column:
        text = F.col(c).cast("string")
        number, day = F.count(text.try_cast("double")), F.count(F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text.try_cast("date")))
        kind = F.when(known(c) == 0, "null").when(day == known(c), "date").when(number == known(c), "numeric").when((number > 0) | (day > 0), "mixed").otherwise("string")
        return F.struct(F.lit(c).alias("column"), kind.alias("type"))

    return df.agg(F.array(*[of(c) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def infer_roles(df: DataFrame, columns: list[str], most: int = 15) -> DataFrame:
    """column, distinct, role: binary for two values, continuous for more than `most`, else discrete."""
    row = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    role = F.when(F.col("distinct") == 2, "binary").when(F.col("distinct") > most, "continuous").otherwise("discrete")
    return row.unpivot([], columns, "column", "distinct").withColumn("role", role)


def suppress(n: Column, least: int = 10) -> Column:
    """The count, or NULL for a cell below least."""
    return F.when(n >= least, n)


def suppressed_counts(df: DataFrame, keys: list, least: int = 10, person: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(suppress(F.count_distinct(person) if person else F.count("*"), least).alias("n"))


def roll_up(df: DataFrame, levels: dict[str, Column], least: int = 10) -> DataFrame:
    """Counts at every level of a hierarchy (outermost first), small cells hidden; depth is the number of levels given."""
    x = df.select([c.alias(n) for n, c in levels.items()])
    depth = sum((1 - F.grouping(n)) for n in levels)
    return x.rollup(*levels).agg(suppress(F.count("*"), least).alias("n"), depth.cast("int").alias("depth"))


def stratify(df: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Counts over all combinations of the keys, small cells hidden; grouping tells which keys are summed over."""
    return df.cube(*keys).agg(suppress(F.count("*"), least).alias("n"), F.grouping_id().cast("int").alias("grouping"))
