"""Pseudonyms and alignment of whole columns: code tables, person keys, schemas, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.functions import unit_hash
from tabveil.session import materialise


def ranged(df: DataFrame, order: list, buckets: int | None = None) -> DataFrame:
    """df dealt into ranges of the order, their numbers as _part; written down, so that all who read it see the same ranges."""
    x = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    return materialise(x.withColumn("_part", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, order: list, name: str, buckets: int | None = None) -> DataFrame:
    """df with a column that numbers its rows from 0 in that order, without a sort of all rows in one task.

    Rows are range-partitioned by the order, numbered within partitions, and shifted by the sizes of those before.
    """
    x = ranged(df, order, buckets)
    sizes = x.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    x = x.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return x.join(F.broadcast(shift), "_part").withColumn(name, (F.col("_row") - 1 + F.col("_shift")).cast("long")).drop("_part", "_row", "_shift")


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: the distinct values numbered from 0 in sorted order; NULL has no code."""
    return numbered(df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct(), [F.col("value")], "code")


def pseudonymise_categories(df: DataFrame, column: str) -> DataFrame:
    """df with the column's values replaced by their codes, NULL by NULL."""
    codes = category_codes(df, column)
    return df.join(codes, F.col(column) == F.col("value"), "left").withColumn(column, F.col("code")).select(df.columns)


def person_pseudonyms(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """key, pseudonym: persons numbered from 1 in an order that only the seed decides, as id000001."""
    persons = df.where(F.col(key).isNotNull()).select(key).distinct()
    return numbered(persons, [unit_hash(seed, F.col(key)), F.col(key)], "_n").select(key, F.format_string("id%06d", F.col("_n") + 1).alias("pseudonym"))


def cast_roles(df: DataFrame, numeric: list[str]) -> DataFrame:
    """The named columns as double, the others as text; columns on diagnoses go unless their name has `age`."""
    keep = [c for c in df.columns if "diagnos" not in c.lower() or "age" in c.lower()]
    return df.select([F.col(c).cast("double" if c in numeric else "string") for c in keep])


def align(df: DataFrame, schema, exclude: tuple[str, ...] = ()) -> DataFrame:
    """df in the schema's columns, order and types: missing ones NULL, others dropped, values that don't fit NULL."""
    have = set(df.columns)
    return df.select([(F.col(f.name).cast("string").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema if f.name not in exclude])


def snap_to_seen(df: DataFrame, real: DataFrame, column: str, most: int = 32) -> DataFrame:
    """Each value moved to the nearest one that the real column has (the smaller of two); at most `most` of these, else df."""
    seen = [r[0] for r in real.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if not seen or len(seen) > most:
        return df
    options = F.array(*[F.struct(F.abs(F.col(column) - v).alias("d"), F.lit(v).alias("v")) for v in sorted(seen)])
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.array_min(options)["v"]))


def running(df: DataFrame, group: str, order: str, sums: list[str], buckets: int | None = None) -> DataFrame:
    """df, whose rows differ in (group, order), with <s>_upto, the sums up to each row within its group, and previous, the order value before it.

    Rows are range-partitioned, summed within partitions, and shifted by the partitions before, so no task holds a
    whole group.
    """
    x = ranged(df, [F.col(group), F.col(order)], buckets)
    parts = x.groupBy("_part", group).agg(*[F.sum(s).alias(f"_{s}") for s in sums], F.max(order).alias("_last"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    shift = parts.select(F.col("_part").alias("_run_part"), F.col(group).alias("_run_group"), *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}") for s in sums], F.max("_last").over(before).alias("_last"))
    here = Window.partitionBy("_part", group).orderBy(order)
    x = x.withColumns({**{f"{s}_upto": F.sum(s).over(here) for s in sums}, "previous": F.lag(order).over(here)})
    x = x.join(shift, (F.col("_part") == F.col("_run_part")) & F.col(group).eqNullSafe(F.col("_run_group")))
    return x.withColumns({**{f"{s}_upto": F.col(f"{s}_upto") + F.col(f"_{s}") for s in sums}, "previous": F.coalesce("previous", "_last")}).select(*df.columns, *[f"{s}_upto" for s in sums], "previous")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], cells: int = 1024, times: str | None = None) -> DataFrame:
    """_g (a struct with the keys), q: the exact quantiles of each group's known values, linear between neighbouring ranks.

    Equal values are counted first; times names a column that says how often a row's value is there. Running counts over range partitions give the ranks that each value covers; the
    wanted ranks meet them by cells of ranks, so neither a task nor a buffer holds a whole group. A group without
    known values has no row.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(F.struct(F.lit(0).alias("_all"), *keys).alias("_g"), F.col(value).cast("double").alias("_v")).agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    x = running(x, "_g", "_v", ["n"])
    width = F.ceil(F.col("_total") / cells)
    total = x.groupBy("_g").agg(F.max("n_upto").alias("_total"))
    covered = x.join(total, "_g").withColumns({"_hi": F.col("n_upto") - 1, "_lo": F.col("n_upto") - F.col("n")})
    covered = covered.select("_g", "_v", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))).alias("_cell"))
    at = total.select("_g", "_total", F.posexplode(F.array(*map(F.lit, shares))).alias("_i", "_share")).withColumn("_at", F.col("_share") * (F.col("_total") - 1))
    low, high = F.floor("_at"), F.ceil("_at")
    part = lambda rank, weight: F.struct(rank.alias("rank"), weight.alias("weight"))
    ends = F.when(low == high, F.array(part(low, F.lit(1.0)))).otherwise(F.array(part(low, high - F.col("_at")), part(high, F.col("_at") - low)))
    wanted = at.select("_g", "_i", F.explode(ends).alias("_x"), width.alias("_width")).select("_g", "_i", "_x.*", F.floor(F.col("_x.rank") / F.col("_width")).alias("_cell"))
    found = covered.join(wanted, ["_g", "_cell"]).where(F.col("rank").between(F.col("_lo"), F.col("_hi")))
    one = found.groupBy("_g", "_i").agg(F.sum(F.col("weight") * F.col("_v")).alias("_q"))
    return one.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q"))  # one entry a share
