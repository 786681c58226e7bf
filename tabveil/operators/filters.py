"""Row selection: constraints, small cells, copies, leaks, rare categories."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.operators.codes import numbered
from tabveil.session import materialise


def constrain(df: DataFrame, rules: list[str], lenient: bool = False) -> DataFrame:
    """Rows that satisfy every SQL predicate; a predicate that is NULL drops the row unless lenient."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.expr(r), F.lit(lenient)) for r in rules], F.lit(True)))


def constraint_report(df: DataFrame, rules: list[str], lenient: bool = False) -> DataFrame:
    """rule, dropped: rows that each rule drops of those the rules before it leave, in one pass."""
    first = F.coalesce(*[F.when(~F.coalesce(F.expr(r), F.lit(lenient)), n) for n, r in enumerate(rules)], F.lit(-1))
    counts = df.groupBy(first.alias("n")).agg(F.count("*").alias("dropped"))
    names = df.sparkSession.createDataFrame(list(enumerate(rules)), "n int, rule string")
    return names.join(counts, "n", "left").select("rule", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def top_up(df: DataFrame, rules: list[str], n: int, order: list[Column], tries: int | None = None, most: int = 10) -> DataFrame:
    """The first n valid rows in the order, with shortfall, what is missing to n: candidates are asked for to the end of the table.

    With `tries` there is a limit to the candidates. They come in order, range by range: the first range has n rows,
    each other as many as the share of valid rows so far says are needed, but at most `most` * n; it ends with n valid
    rows, after `tries` ranges or at the end of the table. The table is then numbered once, over range partitions; a
    range is a filter on the numbers.
    """
    valid = reduce(lambda a, b: a & b, [F.coalesce(F.expr(r), F.lit(False)) for r in rules], F.lit(True))
    if tries is None:
        found = materialise(df.where(valid).orderBy(*order).limit(n), "topped-up")
        return found.withColumn("shortfall", F.lit(n - found.count()).cast("long"))
    pool = materialise(numbered(df.withColumn("_valid", valid), order, "_i"), "pool")
    size, at, got = pool.count(), 0, 0
    for _ in range(tries):
        if got >= n or at >= size:
            break
        rate = got / at if at else 1.0
        ask = min(most * n, math.ceil((n - got) / rate) if rate else most * n)
        got += pool.where(F.col("_i").between(at, at + ask - 1) & F.col("_valid")).count()
        at += ask
    found = pool.where((F.col("_i") < at) & F.col("_valid")).orderBy("_i").limit(n).drop("_i", "_valid")
    return found.withColumn("shortfall", F.lit(max(n - got, 0)).cast("long"))


def match_conditions(df: DataFrame, wanted: dict[str, object], tolerance: float = 0.01) -> DataFrame:
    """Rows that meet the wanted values, floats within a relative tolerance and then set exactly."""
    for c, v in wanted.items():
        df = df.where(F.abs(F.col(c) - v) <= abs(v) * tolerance).withColumn(c, F.lit(v)) if isinstance(v, float) else df.where(F.col(c) == v)
    return df


def drop_small_cells(df: DataFrame, columns: list[str], person: str, least: int = 5) -> DataFrame:
    """Rows whose value in each column is held by at least `least` persons; columns one after another; NULL stays.

    Each step is written down, as the next one reads it twice.
    """
    for n, c in enumerate(columns):
        df = materialise(df, "large-cells") if n else df
        keep = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct(person).alias("_n")).where(F.col("_n") >= least).select(F.col(c).alias("_keep"))
        df = df.join(keep, F.col(c) == F.col("_keep"), "left").where(F.col(c).isNull() | F.col("_keep").isNotNull()).drop("_keep")
    return df


def drop_rare_rows(df: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose value occurs in at least `least` rows; NULL rows stay."""
    keep = df.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col(column).alias("_keep"))
    return df.join(keep, F.col(column) == F.col("_keep"), "left").where(F.col(column).isNull() | F.col("_keep").isNotNull()).drop("_keep")


def unique_code_rows(df: DataFrame, person: str, code: str) -> DataFrame:
    """Rows of persons for whom exactly one holds: a code of theirs is nobody else's; they have several rows."""
    lone = df.groupBy(code).agg(F.count_distinct(person).alias("_n")).where((F.col("_n") == 1) & F.col(code).isNotNull()).select(code)
    own = df.join(lone, code, "left_semi").select(person).distinct().withColumn("_own", F.lit(True))
    several = df.groupBy(person).agg((F.count("*") > 1).alias("_several"))
    who = several.join(own, person, "left").where(F.coalesce("_own", F.lit(False)) != F.col("_several")).select(person)
    return df.join(who, person, "left_semi").select(df.columns)


def drop_copies(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_all_repeated(df: DataFrame) -> DataFrame:
    """Rows that occur once; of the others no copy stays."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def null_safe(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_{c}"]) for c in columns])


def drop_leaks(synthetic: DataFrame, real: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct synthetic rows that no real row equals in all columns (NULL equals NULL)."""
    columns = columns or synthetic.columns
    other = real.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
    synthetic = synthetic.distinct()
    return synthetic.join(other, null_safe(synthetic, other, columns), "left_anti")


def fold_rare(df: DataFrame, train: DataFrame, column: str, share: float, token: str = "_rare_") -> DataFrame:
    """Categories with fewer than round(rows * share) rows in train become one token; NULL stays."""
    n = train.agg(F.bround(F.count("*") * share).alias("_least"))
    keep = train.groupBy(column).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(n)).where("_n >= _least").select(F.col(column).alias("_keep"))  # n is one row
    out = df.join(keep, F.col(column) == F.col("_keep"), "left")
    return out.withColumn(column, F.when(F.col(column).isNull(), None).otherwise(F.coalesce("_keep", F.lit(token)))).select(df.columns)


def common_classes(train: DataFrame, test: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without rows whose label the other one lacks."""
    return train.join(test.select(label).distinct(), label, "left_semi").select(train.columns), test.join(train.select(label).distinct(), label, "left_semi").select(test.columns)


def class_coverage(real: DataFrame, sample: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_real, n_sample, covered: whether the sample has as many distinct values."""
    a, b = (d.agg(*[F.count_distinct(c).alias(c) for c in columns]) for d in (real, sample))
    stack = lambda d, n: d.unpivot([], columns, "column", n)
    return stack(a, "n_real").join(stack(b, "n_sample"), "column").withColumn("covered", F.col("n_real") == F.col("n_sample"))


def out_of_range(df: DataFrame, real: DataFrame, columns: list[str]) -> DataFrame:
    """df with out_of_range: whether a value lies outside the real column's range."""
    ends = real.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    flag = reduce(lambda a, b: a | b, [F.coalesce((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}")), F.lit(False)) for c in columns])
    return df.crossJoin(F.broadcast(ends)).select(*df.columns, flag.alias("out_of_range"))  # ends is one row


def in_groups_of(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Rows whose values in the columns are shared by at least `least` rows (a window: no more rows of one key than a task can take)."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*columns))).where(F.col("_n") >= least).drop("_n")
