"""Splits, folds, samples and bootstraps that only keys and seeds decide: the same on any cluster and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.functions import unit_hash
from tabveil.operators.codes import numbered, running


def split(df: DataFrame, key: list[str], share: float = 0.8, seed: int = 0) -> DataFrame:
    """df with part: train for about that share of the keys, else test."""
    return df.withColumn("part", F.when(unit_hash(seed, *map(F.col, key)) < share, "train").otherwise("test"))


def covering_split(df: DataFrame, key: list[str], columns: list[str], share: float = 0.8, seed: int = 0) -> DataFrame:
    """As split, but of each value of the columns the row of the smallest hash is in train, so that train covers all."""
    h = unit_hash(seed, *map(F.col, key))
    x = df.withColumn("_h", h)
    first = [x.groupBy(c).agg(F.min(F.struct("_h", *key)).alias("_first")).select(F.col(c).alias(f"_{c}"), F.col("_first").alias(f"_first_{c}")) for c in columns]
    chosen = F.lit(False)
    for c, f in zip(columns, first, strict=True):
        x = x.join(f, F.col(c).eqNullSafe(F.col(f"_{c}")))
        chosen = chosen | (F.struct("_h", *key) == F.col(f"_first_{c}"))
    return x.withColumn("part", F.when(chosen | (F.col("_h") < share), "train").otherwise("test")).select(*df.columns, "part")


def stratified_split(df: DataFrame, key: list[str], label: str, share: float = 0.8, seed: int = 0, buckets: int = 64) -> DataFrame:
    """df with part: of each label exactly floor(share * rows), those of the smallest hashes, in train.

    Ranks are taken within slices of the hash and shifted by the slices before, so no task holds a whole label.
    """
    h = unit_hash(seed, *map(F.col, key))
    x = df.withColumns({"_h": h, "_slice": F.floor(h * buckets)})
    sizes = x.groupBy(label, "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    sizes = sizes.select(F.col(label).alias("_label"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_total"))
    rank = F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_h", *key))
    x = x.withColumn("_rank", rank).join(sizes, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_slice") == F.col("_s")))
    return x.withColumn("part", F.when(F.col("_rank") + F.col("_before") <= F.floor(F.col("_total") * share), "train").otherwise("test")).select(*df.columns, "part")


def folds(df: DataFrame, key: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(unit_hash(seed, *map(F.col, key)) * k).cast("int"))


def nested_samples(df: DataFrame, key: list[str], sizes: list[int], seed: int = 0) -> DataFrame:
    """A row of df for each size it belongs to: the rows of the smallest hashes, so smaller samples lie in larger ones."""
    x = numbered(df.withColumn("_h", unit_hash(seed, *map(F.col, key))), [F.col("_h"), *map(F.col, key)], "_nth")
    size = F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda s: s > F.col("_nth")))
    return x.select(*df.columns, size.alias("sample_rows"))


def percent_sample(df: DataFrame, key: list[str], rows: float, columns: float, target: str, seed: int = 0) -> DataFrame:
    """About that share of the rows, and of the columns (the target always among them), in the old order of columns."""
    import hashlib

    others = [c for c in df.columns if c != target]
    order = sorted(others, key=lambda c: hashlib.md5(f"{seed}:{c}".encode()).hexdigest())
    keep = {target, *order[: max(1, round(len(others) * columns))]}
    return df.where(unit_hash(seed, *map(F.col, key)) < rows).select([c for c in df.columns if c in keep])


def covering_sample(df: DataFrame, key: str, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """Rows that hold every value of every column, one (of the smallest key) for each, topped up to n by hash order."""
    values = df.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["_k"], columns, "column", "value")
    must = values.groupBy("column", "value").agg(F.min("_k").alias(key)).select(key).distinct().withColumn("_must", F.lit(0))
    x = df.join(must, key, "left").withColumn("_rank", F.coalesce("_must", F.lit(1)))
    nth = numbered(x, [F.col("_rank"), unit_hash(seed, F.col(key)), F.col(key)], "_nth")
    return nth.where((F.col("_nth") < n) | (F.col("_rank") == 0)).select(df.columns)


def rebalance(df: DataFrame, key: list[str], label: Column, keep: float = 0.25, seed: int = 0) -> DataFrame:
    """All rows where label is false, and about `keep` of those where it is true."""
    return df.where(~label | (unit_hash(seed, *map(F.col, key)) < keep))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))  # one row


def category_weights(df: DataFrame, columns: list[str], log: bool = True) -> DataFrame:
    """column, value, n, weight: log(n + 1) or n as a share of the column's total."""
    x = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = F.ln(F.col("n") + 1) if log else F.col("n").cast("double")
    total = x.groupBy("column").agg(F.sum(w).alias("_total"))
    return x.join(F.broadcast(total), "column").select("column", "value", "n", (w / F.col("_total")).alias("weight"))  # a row for each column name


def pair_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_a, column_b, a, b, n for every pair of columns; pairs are made within each row, so nothing is joined."""
    pairs = [F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b")) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    return df.select(F.explode(F.array(*pairs)).alias("x")).groupBy("x.column_a", "x.column_b", "x.a", "x.b").agg(F.count("*").alias("n"))


def draw_by_category(df: DataFrame, key: str, column: str, draws: DataFrame, seed: int = 0) -> DataFrame:
    """draw, value, key: for each draw a value by its log weight, then one of the value's rows.

    draws has draw. A value's share of [0, 1) is in the order of values; the row is the one of the hash rank that the
    draw's second number points at, by ranks within each value. Shares are whole units, summed over range partitions;
    draws meet them by cells of units, about as many as there are values, and rows by their numbers in the whole table.
    """
    w = category_weights(df, [column]).select("value", "n", F.round(F.col("weight") * (1 << 40)).cast("long").alias("units"), F.lit(0).alias("_g"))
    shares = running(w, "_g", "value", ["units"])
    size = shares.agg(F.sum("units").alias("_all"), F.ceil(F.sum("units") / (2 * F.count("*") + 4096)).alias("_width"))
    cell = lambda x: F.floor(x / F.col("_width"))
    rows = numbered(df.where(F.col(column).isNotNull()).select(key, F.col(column).cast("string").alias("value")), [F.col("value"), unit_hash(seed + 2, F.col(key)), F.col(key)], "_at")
    starts = rows.groupBy("value").agg(F.min("_at").alias("_start"))
    shares = shares.join(starts, "value").crossJoin(F.broadcast(size))  # one row
    hi, lo = F.col("units_upto"), F.col("units_upto") - F.col("units")
    shares = shares.where("units > 0").select("value", "n", "_start", lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(cell(lo), cell(hi - 1))).alias("_cell"))
    at = draws.select("draw").crossJoin(F.broadcast(size)).withColumn("_u", F.floor(unit_hash(seed, F.col("draw")) * F.col("_all")))  # one row
    at = at.select("draw", "_u", cell(F.col("_u")).alias("_cell")).join(shares, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    at = at.select("draw", (F.floor(unit_hash(seed + 1, F.col("draw")) * F.col("n")) + F.col("_start")).alias("_at"))
    return at.join(rows, "_at").select("draw", "value", key)


def bootstrap_means(df: DataFrame, key: list[str], value: str, groups: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """groups, mean and se: the deviation of the means of replicates in which each row has a Poisson(1) weight.

    Meant for score tables: each row is taken once for each replicate and summed up before the shuffle.
    """
    limits = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    u = unit_hash(seed, F.col("_r"), *map(F.col, key))
    weight = sum((u >= x).cast("int") for x in limits)
    x = df.select(*groups, *[k for k in key if k not in groups], F.col(value).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r")).withColumn("_w", weight)
    means = x.groupBy(*groups, "_r").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("_m"))
    se = means.groupBy(*groups).agg(F.stddev_pop("_m").alias("se"))
    return df.groupBy(*groups).agg(F.avg(value).alias("mean")).join(se, groups)
