"""Ranks of models over datasets and metrics, significance, and minimum sufficient row counts.

Score tables have the columns dataset, model, metric, value (and row_number, tid where said). They have a row for each
trial and metric, so windows over one metric are small.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tabveil.operators.sampling import bootstrap_means



def average_rank(df: DataFrame, keys: list[str], value: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """df with the rank of value within the keys, from 1; ties get the mean of their places."""
    w = Window.partitionBy(*keys)
    order = F.desc(value) if descending else F.asc(value)
    return df.withColumn(name, F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def differences(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """df with the step to the next value in the order of `at`; NULL for the last."""
    return df.withColumn("step", F.lead(value).over(Window.partitionBy(*keys).orderBy(at)) - F.col(value))


def elbow(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """keys, elbow: where the step to the next value is least (the smallest such place)."""
    x = differences(df, keys, at, value).where("step IS NOT NULL")
    return x.groupBy(*keys).agg(F.min_by(at, F.struct("step", at)).alias("elbow"))


def knee(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """keys, knee: the point farthest from the chord between the first and the last point, both axes scaled to 0..1."""
    w = Window.partitionBy(*keys)
    ends = df.withColumns({"_x0": F.min(at).over(w), "_x1": F.max(at).over(w), "_y0": F.min_by(value, at).over(w), "_y1": F.max_by(value, at).over(w)})
    d = F.abs(F.try_divide(F.col(value) - F.col("_y0"), F.col("_y1") - F.col("_y0")) - F.try_divide(F.col(at) - F.col("_x0"), F.col("_x1") - F.col("_x0")))
    return ends.withColumn("_d", F.round(d, 12)).groupBy(*keys).agg(F.max_by(at, F.struct("_d", -F.col(at))).alias("knee"))


def moving_average(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """df with smooth: the mean of three neighbours, NULL at both ends."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-1, 1)
    return df.withColumn("smooth", F.when(F.count(value).over(w) == 3, F.avg(value).over(w)))


def usable(loss: Column) -> Column:
    return loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf"))


def best(df: DataFrame, keys: list[str], loss: str, pick: list[str]) -> DataFrame:
    """keys and the picked columns of the row with the least usable loss (then the smallest picked values)."""
    return df.where(usable(F.col(loss))).groupBy(*keys).agg(F.min(F.struct(loss, *pick)).alias("x")).select(*keys, *[f"x.{c}" for c in pick], f"x.{loss}")


def place(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """df numbered 1..n within the keys by falling score, ties by name."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), name)))


def with_direction(scores: DataFrame, directions: DataFrame) -> DataFrame:
    """scores with direction (higher or lower) from a table (metric, direction): an equal name first, else the longest name within; NULL if none."""
    exact = scores.join(F.broadcast(directions.withColumnRenamed("direction", "_exact")), "metric", "left")  # a row for each known metric
    names = scores.select("metric").distinct()
    d = directions.select(F.col("metric").alias("_part"), F.col("direction").alias("_d"))
    part = names.join(F.broadcast(d), F.expr("instr(metric, _part) > 0")).groupBy("metric").agg(F.max_by("_d", F.struct(F.length("_part"), "_part")).alias("_within"))
    return exact.join(part, "metric", "left").withColumn("direction", F.coalesce("_exact", "_within")).drop("_exact", "_within")


WORST = -1e10


def oriented(value: Column, direction: Column) -> Column:
    """Larger is better; what isn't a finite number is worst."""
    return F.when(~usable(value) | value.isNull(), F.lit(WORST)).when(direction == "lower", -value).otherwise(value)


def rank_losses(trials: DataFrame) -> DataFrame:
    """tid, loss: minus the mean over metrics of a trial's average rank; infinite for one that failed.

    trials has tid, metric, direction, value, failed.
    """
    good = trials.where(~F.col("failed")).withColumn("_v", oriented(F.col("value"), F.col("direction")))
    loss = average_rank(good, ["metric"], "_v").groupBy("tid").agg((-F.avg("rank")).alias("loss"))
    lost = trials.where("failed").select("tid").distinct().withColumn("loss", F.lit(float("inf")))
    return loss.unionByName(lost)


def raw_losses(trials: DataFrame, median: bool = False) -> DataFrame:
    x = trials.where(~F.col("failed")).withColumn("_v", oriented(F.col("value"), F.col("direction")))
    loss = x.groupBy("tid").agg((-(F.median("_v") if median else F.avg("_v"))).alias("loss"))
    return loss.unionByName(trials.where("failed").select("tid").distinct().withColumn("loss", F.lit(float("inf"))))


def imbalance_guard(folds: DataFrame) -> DataFrame:
    """Values of a fold (the metric's name up to the first _) are blanked unless its gmean is above 0 and its precision below 1."""
    fold = F.substring_index("metric", "_", 1)
    x = folds.withColumn("_fold", fold)
    ok = x.groupBy("tid", "_fold").agg((F.bool_or(F.col("metric").endswith("_gmean") & (F.col("value") > 0)) & F.bool_or(F.col("metric").endswith("_precision") & (F.col("value") < 1))).alias("_ok"))
    return x.join(ok, ["tid", "_fold"]).withColumn("value", F.when(F.coalesce("_ok", F.lit(False)), F.col("value"))).select(folds.columns)


def mean_ranks(scores: DataFrame) -> DataFrame:
    """dataset, model, mean_rank, place: average ranks of the oriented scores over the metrics that all models have."""
    n = scores.agg(F.count_distinct("model").alias("_all"))
    x = scores.withColumn("_v", oriented(F.col("value"), F.col("direction")))
    whole = x.groupBy("dataset", "metric").agg(F.count_distinct("model").alias("_n")).crossJoin(F.broadcast(n)).where("_n = _all").select("dataset", "metric")  # n is one row
    ranked = average_rank(x.join(whole, ["dataset", "metric"]), ["dataset", "metric"], "_v")
    return place(ranked.groupBy("dataset", "model").agg(F.avg("rank").alias("mean_rank")), ["dataset"], "mean_rank", "model")


def studentised_range_quantile(k: int, alpha: float) -> float:
    """The upper alpha point of the range of k standard normals, divided by the root of 2, by bisection."""
    normal, steps = NormalDist(), 400
    z = [-8 + 16 * i / steps for i in range(steps + 1)]
    density = [normal.pdf(x) for x in z]

    def above(q: float) -> float:
        y = [d * max(0.0, normal.cdf(x) - normal.cdf(x - q)) ** (k - 1) for x, d in zip(z, density, strict=True)]
        return 1 - k * (16 / steps / 3) * (y[0] + y[-1] + 4 * sum(y[1:-1:2]) + 2 * sum(y[2:-1:2]))

    lo, hi = 0.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > alpha else (lo, mid)
    return lo / math.sqrt(2)


def critical_difference(k: int, n: int, alpha: float = 0.05) -> float:
    return studentised_range_quantile(k, alpha) * math.sqrt(k * (k + 1) / (6 * n))


def rank_gaps(ranks: DataFrame, k: int, n: int) -> DataFrame:
    """a, b, gap, mark for every ordered pair of models (model, mean_rank): +, - or 0, doubled from the 0.05 and tripled from the 0.01 difference on."""
    five, one = critical_difference(k, n, 0.05), critical_difference(k, n, 0.01)
    x, y = ranks.select(F.col("model").alias("a"), F.col("mean_rank").alias("_a")), ranks.select(F.col("model").alias("b"), F.col("mean_rank").alias("_b"))
    gap = F.col("_a") - F.col("_b")
    sign = F.when(gap > 0, "+").when(gap < 0, "-").otherwise("0")
    mark = F.expr("CASE WHEN sign = '0' THEN '0' ELSE repeat(sign, times) END")
    times = F.when(F.abs(gap) >= one, 3).when(F.abs(gap) >= five, 2).otherwise(1)
    return x.join(F.broadcast(y), F.col("a") != F.col("b")).select("a", "b", gap.alias("gap"), sign.alias("sign"), times.alias("times")).withColumn("mark", mark).drop("sign", "times")  # a row for each model


def rank_gap_report(ranks: DataFrame, alphas: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """a, b, gap, mark, models, blocks and cd_<percent> for every ordered pair of models, from mean ranks by block (dataset, model, mean_rank).

    The models and the datasets are counted; cd is the critical difference of mean ranks at each level. One model has
    no pairs.
    """
    size = ranks.agg(F.count_distinct("model").alias("k"), F.count_distinct("dataset").alias("n")).first()
    mean = ranks.groupBy("model").agg(F.avg("mean_rank").alias("mean_rank"))
    if size.k < 2:
        return rank_gaps(mean.limit(0), 2, 1).withColumns({"models": F.lit(size.k), "blocks": F.lit(size.n), **{f"cd_{round(100 * a)}": F.lit(None).cast("double") for a in alphas}})
    levels = {f"cd_{round(100 * a)}": F.lit(critical_difference(size.k, size.n, a)) for a in alphas}
    return rank_gaps(mean, size.k, size.n).withColumns({"models": F.lit(size.k), "blocks": F.lit(size.n), **levels})


def friedman(scores: DataFrame, block: list[str]) -> DataFrame:
    """One row: k models, n blocks, statistic (corrected for ties) over score tables with model and value.

    The statistic is NaN where it isn't defined: one model, or all models tied in every block; NULL without scores.
    """
    x = average_rank(scores, block, "value")
    models = x.groupBy("model").agg(F.avg("rank").alias("m"))
    ties = x.groupBy(*block, "value").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = x.select(*block).distinct().agg(F.count("*").cast("double").alias("n"))
    s = models.agg(F.count("*").cast("double").alias("k"), F.sum(F.col("m") * F.col("m")).alias("m2"), F.sum("m").alias("m1")).crossJoin(n).crossJoin(ties)  # one row each
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), a * F.lit(math.inf))  # noqa: E731  as floating point divides by 0
    square = F.col("m2") - ratio(F.col("m1") * F.col("m1"), F.col("k"))
    raw = ratio(F.lit(12.0) * F.col("n"), F.col("k") * (F.col("k") + 1)) * square
    known = 1 - ratio(F.col("ties"), F.col("n") * F.col("k") * (F.col("k") * F.col("k") - 1))
    return s.select(F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), ratio(raw, known).alias("statistic"))


def win_rates(scores: DataFrame, block: list[str]) -> DataFrame:
    """a, b, win_rate: the share of blocks in which a has the larger value, ties half."""
    x, y = scores.select(*block, F.col("model").alias("a"), F.col("value").alias("_a")), scores.select(*block, F.col("model").alias("b"), F.col("value").alias("_b"))
    won = F.when(F.col("_a") > F.col("_b"), 1.0).when(F.col("_a") == F.col("_b"), 0.5).otherwise(0.0)
    return x.join(y, block).where("a != b").groupBy("a", "b").agg(F.avg(won).alias("win_rate"))


def win_rates_with_error(scores: DataFrame, block: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """a, b, win_rate, se: as win_rates, with the deviation of the rates of replicates in which each block has a Poisson(1) weight."""
    x, y = scores.select(*block, F.col("model").alias("a"), F.col("value").alias("_a")), scores.select(*block, F.col("model").alias("b"), F.col("value").alias("_b"))
    won = F.when(F.col("_a") > F.col("_b"), 1.0).when(F.col("_a") == F.col("_b"), 0.5).otherwise(0.0)
    pairs = x.join(y, block).where("a != b").select(*block, "a", "b", won.alias("won"))
    return bootstrap_means(pairs, block, "won", ["a", "b"], replicates, seed).withColumnRenamed("mean", "win_rate")


def threshold_scores(scores: DataFrame, ranges: DataFrame) -> DataFrame:
    """scores with score, the threshold score of each value; ranges has metric, low, high, and a metric that isn't there gives 0.5."""
    known = ranges.select(F.col("metric").alias("_metric"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    x = scores.join(F.broadcast(known), F.col("metric") == F.col("_metric"), "left")  # a row for each metric
    return x.select(*scores.columns, threshold_score(F.col("value"), F.col("_low"), F.col("_high")).alias("score"))


def rank_matrix(ranks: DataFrame, models: list[str]) -> DataFrame:
    """dataset, a column of mean ranks for each model, and their average."""
    x = ranks.groupBy("dataset").pivot("model", models).agg(F.first("mean_rank"))
    known = [F.col(m) for m in models]
    return x.withColumn("average", reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in known]) / reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in known]))


def runtime_summary(trials: DataFrame, keys: list[str], start: str, end: str, done: Column) -> DataFrame:
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return trials.groupBy(*keys).agg(F.count("*").alias("trials"), F.count_if(done).alias("successful"), F.count_if(F.col(end).isNull()).alias("incomplete"), F.avg(F.when(done, seconds)).alias("seconds"))


def consistent_metrics(scores: DataFrame) -> DataFrame:
    """Rows of the metrics that have a finite value at every row_number and aren't constant."""
    n = scores.agg(F.count_distinct("row_number").alias("_all"))
    good = scores.groupBy("metric").agg(F.count_distinct("row_number").alias("_n"), F.bool_and(usable(F.col("value")) & F.col("value").isNotNull()).alias("_ok"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    good = good.crossJoin(F.broadcast(n)).where("_n = _all AND _ok AND _lo <> _hi").select("metric")  # n is one row
    return scores.join(good, "metric", "left_semi")


def threshold_score(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low) within 0..1; 0.5 for a metric without a range."""
    share = F.try_divide(value - low, high - low)
    return F.when(share.isNull(), 0.5).otherwise(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)))


def composite(scores: DataFrame, ranges: DataFrame) -> DataFrame:
    """row_number, score: the mean threshold score; ranges has metric, low, high."""
    x = scores.join(F.broadcast(ranges), "metric", "left")  # a row for each metric
    return x.groupBy("row_number").agg(F.avg(threshold_score(F.col("value"), F.col("low"), F.col("high"))).alias("score"))


def sufficiency_ranks(scores: DataFrame) -> DataFrame:
    """row_number, mean_rank over metrics, row counts taking the place of models."""
    return average_rank(scores, ["metric"], "value").groupBy("row_number").agg(F.avg("rank").alias("mean_rank"))
