"""Many hash samples of one table at once: a row carries the list of samples that it is in, and one grouping by sample gives every statistic.

The table is scanned once whatever the number of samples; rows are summed up by sample before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import unit_hash
from tabveil.session import ship

REAL = -1


def replicate_lists(df: DataFrame, key: str, rounds: int, share: float, side: int = 0) -> DataFrame:
    """df with reps, the rounds whose sample a row is in: in each a row is in with probability `share`, decided by side, round and key alone.

    One MD5 gives four numbers, for four rounds.
    """
    digest = lambda n: F.md5(F.concat_ws(":", F.lit(str(side)), F.lit(str(n)), F.col(key).cast("string")))
    digests = F.array(*[digest(n) for n in range((rounds + 3) // 4)])
    cut = int(share * 2**32)
    least = f"{cut:08x}" if cut < 2**32 else "g"  # hex numbers of one length are in order as text
    drawn = F.transform("_digests", lambda d, n: F.filter(F.array(*[F.when(F.substring(d, 8 * j + 1, 8) < least, (4 * n + j).cast("int")) for j in range(4)]), lambda r: r < rounds))
    return df.withColumn("_digests", digests).withColumn("reps", F.flatten(drawn)).drop("_digests")


def unit_lists(df: DataFrame, key: str, rounds: int, share: float) -> DataFrame:
    """The same with one hash a round, that of unit_hash(round, key)."""
    return df.withColumn("reps", F.filter(F.array(*[F.when(unit_hash(i, F.col(key)) < share, i) for i in range(rounds)]), lambda r: r.isNotNull()))


def replicated_aggregates(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """rep and the aggregates of each sample of df (with reps) that has a row."""
    return df.withColumn("rep", F.explode("reps")).groupBy("rep").agg(*[a.alias(n) for n, a in aggregates.items()])


def over_replicates(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """<name>_mean and <name>_std of each aggregate over the samples."""
    return replicated_aggregates(df, aggregates).agg(*[f(n).alias(f"{n}_{s}") for n in aggregates for s, f in (("mean", F.avg), ("std", F.stddev_pop))])


def statistics(df: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    """rep, column, value, n, r, varies of df (with reps): counts of the discrete columns' known values; and, where column is NULL, the correlations of all pairs of continuous columns and whether each varies, over rows known in all of them.

    Rows aren't multiplied by their samples: each batch of them is summed up by sample and value, and Spark adds up what
    the batches have. Moments are taken about the table's means.
    """
    ship(df.sparkSession)
    pairs = [(i, j) for i in range(len(continuous)) for j in range(i, len(continuous))]
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    got = df.agg(F.lit(0), *[F.avg(number(c)) for c in continuous]).first()
    pivot = [v or 0.0 for v in got[1:]]
    names = ["rep", "column", "value", "n", "known", "sums", "products", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row, rep = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            width = int(rep.max(initial=-1)) + 2  # samples count from -1
            x = [pc.fill_null(b.column(1 + len(discrete) + i), math.nan).to_numpy(zero_copy_only=False) - m for i, m in enumerate(pivot)]
            known = ~np.isnan(x).any(axis=0) if x else np.ones(len(size), bool)
            n = np.bincount(rep + 1, minlength=width)
            some = np.flatnonzero(n)
            use = known[row]
            row_, rep_ = row[use], rep[use]
            order = np.argsort(rep_.astype(np.int32), kind="stable")
            row_, rep_ = row_[order], rep_[order]
            first = np.searchsorted(rep_, some - 1)
            here = np.bincount(rep_ + 1, minlength=width)[some]

            def by_rep(f: np.ufunc, v: np.ndarray, empty: float) -> np.ndarray:
                out = np.full(len(some), float(empty))
                full = here > 0
                out[full] = f.reduceat(v[row_], first[full]) if full.any() else 0
                return out

            lines = lambda v: pa.array([r.tolist() for r in np.array(v).reshape(len(v), len(some)).T], pa.list_(pa.float64()))
            nothing = pa.nulls(len(some), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array((some - 1).astype(np.int32)), nothing, nothing, pa.array(n[some]), pa.array(here), lines([by_rep(np.add, v, 0) for v in x]), lines([by_rep(np.add, x[i] * x[j], 0) for i, j in pairs]),
                                              lines([by_rep(np.minimum, v, math.inf) for v in x]), lines([by_rep(np.maximum, v, -math.inf) for v in x])], names)
            for i, c in enumerate(discrete):
                codes = b.column(1 + i).dictionary_encode()
                code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                key, times = np.unique(code[code >= 0] * width + rep[code >= 0] + 1, return_counts=True)
                none = pa.nulls(len(key), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array((key % width - 1).astype(np.int32)), pa.array([c] * len(key), pa.string()), codes.dictionary.take(pa.array(key // width)), pa.array(times), pa.array(times), none, none, none, none], names)

    x = df.select("reps", *[F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(discrete)], *[number(c).alias(f"x{i}") for i, c in enumerate(continuous)])
    x = x.mapInArrow(run, "rep int, column string, value string, n long, known long, sums array<double>, products array<double>, low array<double>, high array<double>")
    each = lambda f, c, size: F.array(*[f(F.get(c, i)) for i in range(size)]) if size else F.array().cast("array<double>")
    width = len(continuous)
    x = x.groupBy("rep", "column", "value").agg(F.sum("n").alias("n"), F.sum("known").alias("_n"), each(F.sum, "sums", width).alias("_s"), each(F.sum, "products", len(pairs)).alias("_p"), each(F.min, "low", width).alias("_lo"), each(F.max, "high", width).alias("_hi"))
    varies = [F.coalesce(F.get("_lo", i) < F.get("_hi", i), F.lit(False)) for i in range(width)]
    moment = lambda i, j: F.get("_p", pairs.index((i, j))) - F.try_divide(F.get("_s", i) * F.get("_s", j), F.col("_n"))
    r = [F.coalesce(F.when(varies[i] & varies[j], F.try_divide(moment(i, j), F.sqrt(moment(i, i) * moment(j, j)))), F.lit(0.0)) for i, j in pairs if i < j]
    return x.select("rep", "column", "value", "n", (F.array(*r) if r else F.array().cast("array<double>")).alias("r"), (F.array(*[v.cast("int") for v in varies]) if varies else F.array().cast("array<int>")).alias("varies"))


def sample_scores(real: DataFrame, samples: DataFrame, rounds: int, discrete: list[str], continuous: list[str], weight: float = 10.0) -> DataFrame:
    """sample, value, covered: for each of the rounds of samples (with reps) the correlation distance from the real table plus `weight` times the mean discrete distance of shares, and whether the sample has as many distinct values in each discrete column.

    An empty sample has shares and correlations of 0. All statistics come from one scan of each table, and its means from another.
    """
    spark = real.sparkSession
    a = statistics(real.withColumn("reps", F.array(F.lit(REAL))), discrete, continuous)
    b = statistics(samples, discrete, continuous)
    shares = lambda x, p: x.where("column IS NOT NULL").join(F.broadcast(x.where("column IS NOT NULL").groupBy("rep", "column").agg(F.sum("n").alias("_all"))), ["rep", "column"]).select("rep", "column", "value", (F.col("n") / F.col("_all")).alias(p))  # noqa: E731  a row a sample and column
    p, q = shares(a, "p").drop("rep"), shares(b, "q")
    classes = p.groupBy("column").agg(F.count("*").alias("classes"))
    gained = q.join(p, ["column", "value"], "left").groupBy("rep", "column").agg(F.sum(F.abs(F.col("p") - F.col("q")) - F.col("p")).alias("gained"), F.count("*").alias("seen"))  # what a class adds beyond its own share
    every = spark.range(rounds).select(F.col("id").cast("int").alias("rep"))
    by_class = every.crossJoin(F.broadcast(classes)).join(gained, ["rep", "column"], "left").na.fill(0, ["gained", "seen"])  # rounds by columns
    distance = (1 + F.col("gained")) / F.col("classes") / math.sqrt(2)
    told = by_class.groupBy("rep").agg(F.avg(distance).alias("dwp"), F.bool_and(F.col("seen") == F.col("classes")).alias("covered"))
    whole = a.where("column IS NULL").select(F.col("r").alias("_r"), F.col("varies").alias("_varies"))
    mine = every.join(b.where("column IS NULL"), "rep", "left").crossJoin(F.broadcast(whole))  # one row
    apart = lambda x, y: F.aggregate(F.transform(y, lambda v, i: F.abs(v - F.coalesce(F.get(x, i), F.lit(0)))), F.lit(0.0), lambda s, v: s + v)
    off = (2 * apart("r", "_r") + apart("varies", "_varies")) / len(continuous) ** 2 if continuous else F.lit(0.0)
    return mine.select("rep", off.alias("off")).join(told, "rep", "left").select(F.col("rep").alias("sample"), (F.col("off") + weight * F.coalesce("dwp", F.lit(0.0))).alias("value"), F.coalesce("covered", F.lit(True)).alias("covered"))


def best_sample(scores: DataFrame) -> DataFrame:
    """One row: sample and value, the covering sample of the smallest value (ties to the smaller number); NULL if none covers."""
    best = F.min(F.when(F.col("covered"), F.struct("value", "sample")))
    return scores.agg(best.alias("x")).select("x.sample", "x.value")
