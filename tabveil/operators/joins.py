"""Joins of registries and of count and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.operators.filters import null_safe


def join_registries(key: str, *tables: DataFrame) -> DataFrame:
    """Full outer joins on the person key, one after the other."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full")
    return out


def join_through(df: DataFrame, mapping: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """df with other's columns through a key map (key, other_key); rows without a key go first."""
    return df.where(F.col(key).isNotNull()).join(mapping.na.drop(subset=[key, other_key]), key).join(other, other_key)


def row_overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows that both tables have (NULL equals NULL)."""
    return a.select(*columns).intersect(b.select(*columns))


def rows_in(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """a's rows, copies included, that b has too."""
    other = b.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
    return a.join(other, null_safe(a, other, columns), "left_semi")


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n, p: counts and shares of each column's values, NULL left out."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "column").select("column", "value", "n", (F.col("n") / F.col("total")).alias("p"))  # a row for each column name


def paired_shares(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n, m, p, q over the union of both tables' categories, 0 where one lacks it."""
    a, b = shares(real, columns), shares(synthetic, columns).withColumnsRenamed({"n": "m", "p": "q"})
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, ["column", "value"], "full").select("column", "value", zero("n"), zero("m"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def score_table(scores: DataFrame, models: list[str]) -> DataFrame:
    """dataset, metric and a column for each model; only rows that all models have."""
    return scores.groupBy("dataset", "metric").pivot("model", models).agg(F.first("value")).na.drop("any", subset=models)
