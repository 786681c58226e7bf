"""Privacy of a synthetic table against a real one: anonymity, closeness, attribution, linkage, membership."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import unit_hash
from tabveil.operators.codes import quantiles, running
from tabveil.operators.cells import numeric_rows
from tabveil.operators.neighbours import k_nearest, search
from tabveil.operators.replicates import replicate_lists
from tabveil.session import materialise


def k_anonymity(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the size of the smallest class of rows equal in the keys; NULL for an empty table."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.min("n").alias("k"))


def l_diversity(df: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """One row: the fewest distinct sensitive values in a class."""
    return df.groupBy(*keys).agg(F.count_distinct(sensitive).alias("n")).agg(F.min("n").alias("l"))


def fit_clusters(df: DataFrame, columns: list[str], k: int, seed: int = 7) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(vectors(df, columns))


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(df)


def cluster_sizes(model: KMeansModel, df: DataFrame, columns: list[str], *extra: Column) -> DataFrame:
    return model.transform(vectors(df, columns)).groupBy("cluster").agg(F.count("*").alias("n"), *extra)


def cluster_anonymity(real: DataFrame, synthetic: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 5, 10, 15)) -> DataFrame:
    """clusters, real, synthetic, safe: the smallest cluster of each table, clustered by itself; a count that leaves fewer than 10 rows a cluster is skipped."""
    return _over_clusters(real, synthetic, columns, ks, F.count("*"), F.min)


def cluster_diversity(real: DataFrame, synthetic: DataFrame, columns: list[str], keys: list[str], ks: tuple[int, ...] = (2, 5, 10, 15)) -> DataFrame:
    """clusters, real, synthetic, safe: the fewest distinct key tuples in a cluster."""
    return _over_clusters(real, synthetic, columns, ks, F.count_distinct(F.struct(*keys)), F.min)


def _over_clusters(real, synthetic, columns, ks, measure, pick) -> DataFrame:
    spark, rows = real.sparkSession, []
    n = min(real.count(), synthetic.count())
    for k in ks:
        if n / k >= 10:
            a, b = (cluster_sizes(fit_clusters(d, columns, k), d, columns, measure.alias("v")).agg(pick("v")).first()[0] for d in (real, synthetic))
            rows.append((k, a, b, b >= a))
    return spark.createDataFrame(rows, "clusters int, real long, synthetic long, safe boolean")


def k_map(real: DataFrame, synthetic: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 4, 8, 16)) -> DataFrame:
    """clusters, k: the smallest occupied cluster of synthetic rows in clusters fitted on the real ones."""
    n = real.count()
    rows = [(k, cluster_sizes(fit_clusters(real, columns, k), synthetic, columns).agg(F.min("n")).first()[0]) for k in ks if n / k >= 10]
    return real.sparkSession.createDataFrame(rows, "clusters int, k long")


def delta_presence(real: DataFrame, synthetic: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 4, 8, 16)) -> DataFrame:
    """clusters, delta: the largest ratio of real to synthetic rows in a cluster that has both."""
    rows, n = [], real.count()
    for k in ks:
        if n / k >= 10:
            model = fit_clusters(real, columns, k)
            x = cluster_sizes(model, real, columns).join(cluster_sizes(model, synthetic, columns).withColumnRenamed("n", "m"), "cluster")
            rows.append((k, x.agg(F.max(F.col("n") / (F.col("m") + 1e-8))).first()[0]))
    return real.sparkSession.createDataFrame(rows, "clusters int, delta double")


def class_presence(real: DataFrame, synthetic: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the largest ratio of real to synthetic rows over classes of the keys that both have."""
    count = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(n))
    return count(real, "n").join(count(synthetic, "m"), keys).agg(F.max(F.col("n") / (F.col("m") + 1e-8)).alias("delta"))


def standardised(df: DataFrame, columns: list[str], by: DataFrame | None = None, scale: str = "deviation") -> DataFrame:
    """df with the columns shifted by mean and divided by deviation (or only by range) of `by` (or of df); a constant column becomes 0."""
    s = (by if by is not None else df).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop if scale == "deviation" else lambda c: F.max(c) - F.min(c)))])
    x = df.crossJoin(F.broadcast(s))  # one row
    return x.select(*[F.coalesce(F.try_divide(F.col(c) - (F.col(f"_m_{c}") if scale == "deviation" else 0.0), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def closest_record(real: DataFrame, synthetic: DataFrame, columns: list[str], id_column: str = "id", share: float = 0.05) -> DataFrame:
    """One row: dcr and nndr, the `share` quantiles of the nearest distance from real to synthetic rows, and of its ratio to the next; each side standardised by itself."""
    x = k_nearest(standardised(real, columns), standardised(synthetic, columns), columns, 2, id_column=id_column)
    return _closeness(x, share)


def closest_within(df: DataFrame, columns: list[str], id_column: str = "id", share: float = 0.05) -> DataFrame:
    """The same within one table, a row not being its own neighbour."""
    x = standardised(df, columns)
    return _closeness(k_nearest(x, x, columns, 2, id_column=id_column, exclude_self=True), share)


def bootstrapped_closest_record(real: DataFrame, synthetic: DataFrame, columns: list[str], id_column: str = "id", rounds: int = 100, sample: float = 0.15, share: float = 0.05) -> DataFrame:
    """One row: dcr and nndr, means over the rounds of what closest_record gives for a sample of both tables, standardised by the samples' own means and deviations.

    A row carries the list of its rounds, so all rounds share one pass for means and deviations and one neighbour
    search: a real row is asked once for each of its rounds, from where the two standardisations put it among the
    synthetic rows, distances weighted by the synthetic deviations. Rounds in which a side has no row give nothing.
    """
    width = len(columns)
    a, b = (materialise(replicate_lists(numeric_rows(d, columns, id_column), "id", rounds, sample, side), "replicates") for side, d in enumerate((real, synthetic)))

    def scale(d: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        parts = [f(F.get("x", i)).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        mean, dev = np.zeros((rounds, width)), np.zeros((rounds, width))
        for r in d.select("x", F.explode("reps").alias("rep")).groupBy("rep").agg(*parts).collect():  # a row a round
            mean[r.rep], dev[r.rep] = [r[f"m{i}"] for i in range(width)], [r[f"s{i}"] for i in range(width)]
        return mean, dev

    (ma, sa), (mb, sb) = scale(a), scale(b)
    over = lambda s: np.where(s > 0, 1 / np.where(s > 0, s, 1), 0.0)  # noqa: E731  a constant column becomes 0
    factor = over(sa) * np.where(sb > 0, sb, 1)
    weights = np.where(sb > 0, over(sb), 1.0)  # where all are equal to the mean, the place alone is standardised
    moves = real.sparkSession.createDataFrame([(r, *(v[r].tolist() for v in (factor, ma, mb))) for r in range(rounds)], "rep int, f array<double>, m array<double>, t array<double>")
    asked = a.select("id", "x", F.explode("reps").alias("rep")).join(F.broadcast(moves), "rep")  # a row a round
    moved = asked.select("id", "rep", F.transform("x", lambda v, i: (v - F.get("m", i)) * F.get("f", i) + F.get("t", i)).alias("x"))
    x, _ = search(moved, b, width, 2, weights=weights)
    d = x.groupBy("id", "rep").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    long = d.select("rep", F.col("d1").alias("dcr"), F.try_divide("d1", "d2").alias("nndr")).unpivot("rep", ["dcr", "nndr"], "name", "v")
    q = quantiles(long, ["rep", "name"], "v", [share]).select("_g.name", F.col("q")[0].alias("q"))
    return q.agg(*[F.avg(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in ("dcr", "nndr")])


def _closeness(x: DataFrame, share: float) -> DataFrame:
    d = x.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    long = d.select(F.col("d1").alias("dcr"), F.try_divide("d1", "d2").alias("nndr")).unpivot([], ["dcr", "nndr"], "name", "v")
    q = quantiles(long, ["name"], "v", [share])
    return q.agg(*[F.max(F.when(F.col("_g.name") == n, F.col("q")[0])).alias(n) for n in ("dcr", "nndr")])


def reidentification(real: DataFrame, synthetic: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """One row: the share of real rows nearer to a synthetic row than to any other real row, columns divided by the entropy of their rounded real values."""
    long = real.select([F.round(c).alias(c) for c in columns]).unpivot([], columns, "column", "v").groupBy("column", "v").agg(F.count("*").alias("n"))
    total = long.groupBy("column").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    weights = {r.column: r.h or 1.0 for r in long.join(F.broadcast(total), "column").groupBy("column").agg((-F.sum(p * F.ln(p))).alias("h")).collect()}  # a row for each column
    scaled = lambda d: d.select(F.col(id_column).alias("id"), *[(F.col(c) / weights[c]).alias(c) for c in columns])
    a, b = scaled(real), scaled(synthetic)
    own = k_nearest(a, a, columns, 1, exclude_self=True).select("id", F.col("distance").alias("own"))
    return own.join(k_nearest(a, b, columns, 1).select("id", "distance"), "id").agg(F.avg((F.col("distance") < F.col("own")).cast("double")).alias("share"))


def train_closeness(train: DataFrame, hold: DataFrame, synthetic: DataFrame, continuous: list[str], discrete: dict[str, list[str]], id_column: str = "id") -> DataFrame:
    """One row: the share of synthetic rows nearer (L1 on range-scaled numbers and one-hot categories) to train than to hold-out."""
    hot = {f"{c}_{i}": (F.col(c) == v).cast("double") for c, values in discrete.items() for i, v in enumerate(values)}
    flat = lambda d: standardised(d, continuous, train, "range").select(F.col(id_column).alias("id"), *continuous, *[x.alias(n) for n, x in hot.items()])
    columns = [*continuous, *hot]
    d = [k_nearest(flat(synthetic), flat(t), columns, 1, "l1").select("id", F.col("distance").alias(n)) for t, n in ((train, "d_train"), (hold, "d_hold"))]
    return d[0].join(d[1], "id").agg(F.avg((F.col("d_train") < F.col("d_hold")).cast("double")).alias("share"))


def attribution(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """One row: 1 - the mean share, among synthetic rows with a real row's keys, of those with its sensitive value; no such rows count 0."""
    pair = synthetic.groupBy(*keys, sensitive).agg(F.count("*").alias("hit"))
    all_ = synthetic.groupBy(*keys).agg(F.count("*").alias("all"))
    x = real.select(*keys, sensitive).groupBy(*keys, sensitive).agg(F.count("*").alias("n")).join(pair, [*keys, sensitive], "left").join(all_, keys, "left")
    return x.agg((1 - F.sum(F.col("n") * F.coalesce(F.col("hit") / F.col("all"), F.lit(0.0))) / F.sum("n")).alias("cap"))


def generalised_attribution(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """As attribution, but with the synthetic key tuples that differ from the real one in the fewest keys; NULL equals NULL in a key, and no other value.

    Tuples meet on the subsets of the keys, level by level from all keys down, each level only for real tuples that no
    larger subset has matched. A level's subsets share one join, so there are at most as many joins as keys and one.
    """
    x = materialise(real.groupBy(*keys, sensitive).agg(F.count("*").alias("n")).withColumn("_id", F.monotonically_increasing_id()), "tuples")
    counts = materialise(synthetic.groupBy(*keys, sensitive).agg(F.count("*").alias("m")), "counts")
    total, found = x.agg(F.sum("n")).first()[0], None
    for size in range(len(keys), -1, -1):
        masks = [sum(1 << i for i in s) for s in combinations(range(len(keys)), size)]
        part = lambda i: F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) > 0, F.struct(F.col(keys[i]).alias("v"))).alias(f"k{i}")
        cut = lambda d: d.withColumn("_mask", F.explode(F.array(*map(F.lit, masks)))).withColumn("_k", F.struct("_mask", *map(part, range(len(keys)))))  # noqa: E731, B023
        there = cut(counts).groupBy("_k", F.col(sensitive).alias("_v")).agg(F.sum("m").alias("m"))
        met = cut(x).select("_id", "n", sensitive, "_k").join(there, "_k").groupBy("_id", "n").agg(F.sum("m").alias("all"), F.coalesce(F.sum(F.when(F.col(sensitive) == F.col("_v"), F.col("m"))), F.lit(0)).alias("hit"))
        met = materialise(met, "matched")
        found = met if found is None else found.unionByName(met)
        x = materialise(x.join(met.select("_id"), "_id", "left_anti"), "unmatched")
        if x.isEmpty():
            break
    return found.agg((1 - F.sum(F.col("n") * F.col("hit") / F.col("all")) / F.lit(total)).alias("cap"))


def singling_out(real: DataFrame, control: DataFrame, synthetic: DataFrame, columns: list[str], attacks: int = 500) -> DataFrame:
    """attacks, success, control: predicates `column = value` from values that one synthetic row has, and how many pick out one row of each table."""
    lone = synthetic.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n")).where("n = 1")
    guesses = lone.orderBy(unit_hash(0, F.col("column"), F.col("value")), "column", "value").limit(attacks).select("column", "value")

    def hits(d: DataFrame, name: str) -> DataFrame:
        x = d.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").join(F.broadcast(guesses), ["column", "value"])  # at most `attacks` rows
        return x.groupBy("column", "value").agg(F.count("*").alias("n")).where("n = 1").agg(F.count("*").alias(name))

    return guesses.agg(F.count("*").alias("attacks")).crossJoin(hits(real, "success")).crossJoin(hits(control, "control"))  # one row each


def multivariate_singling_out(real: DataFrame, control: DataFrame, synthetic: DataFrame, columns: list[str], attacks: int = 500) -> DataFrame:
    """As singling_out with the conjunction of the columns' values in rows that are unique in them."""
    lone = synthetic.groupBy(*columns).agg(F.count("*").alias("n")).where("n = 1")
    guesses = lone.orderBy(unit_hash(0, *map(F.col, columns)), *columns).limit(attacks).select(columns)
    hits = lambda d, name: d.join(F.broadcast(guesses), columns).groupBy(*columns).agg(F.count("*").alias("n")).where("n = 1").agg(F.count("*").alias(name))  # noqa: E731  at most `attacks` rows
    return guesses.agg(F.count("*").alias("attacks")).crossJoin(hits(real, "success")).crossJoin(hits(control, "control"))  # one row each


def linkability(targets: DataFrame, synthetic: DataFrame, left: list[str], right: list[str], k: int = 4, id_column: str = "id") -> DataFrame:
    """One row: targets, and links, those of which some synthetic row is among the k nearest by both halves of the columns."""
    x = linked_ranks(targets, synthetic, left, right, k, id_column=id_column)
    return targets.agg(F.count("*").alias("targets")).crossJoin(x.agg(F.count("*").alias("links")))  # one row each


def linked_ranks(targets: DataFrame, synthetic: DataFrame, left: list[str], right: list[str], k: int, metric: str = "l2", id_column: str = "id") -> DataFrame:
    """id, k: the fewest neighbours by each half of the columns among which the halves of a target share a synthetic row, where k are enough."""
    near = lambda c, name: k_nearest(targets, synthetic, c, k, metric, id_column=id_column).select("id", "other", F.col("rank").alias(name))
    return near(left, "_a").join(near(right, "_b"), ["id", "other"]).groupBy("id").agg(F.min(F.greatest("_a", "_b")).alias("k"))


def linkability_risks(real: DataFrame, control: DataFrame, synthetic: DataFrame, left: list[str], right: list[str], ks: tuple[int, ...] = (4, 5, 6, 7, 8, 9, 10), attacks: int = 5000, metric: str = "l2", id_column: str = "id") -> DataFrame:
    """k, attacks, success, controls, control_success, baseline: links within k neighbours among real targets and among those of the control, for every k from one search of each half.

    Targets are the `attacks` rows of a table with the smallest hashes of their ids; baseline is the chance that two
    random draws of k synthetic rows share one.
    """
    spark, most = real.sparkSession, max(ks)
    n = synthetic.count()
    chance = [(k, 1 - math.prod(max(n - k - i, 0) / (n - i) for i in range(k)) if n >= k else 1.0) for k in ks]
    out = F.broadcast(spark.createDataFrame(chance, "k int, baseline double"))
    for table, total, name in ((real, "attacks", "success"), (control, "controls", "control_success")):
        picked = materialise(table.orderBy(unit_hash(0, F.col(id_column)), id_column).limit(attacks), "targets")
        found = linked_ranks(picked, synthetic, left, right, most, metric, id_column).groupBy("k").agg(F.count("*").alias("_n"))
        upto = F.coalesce(F.sum(F.when(F.col("_k") <= F.col("k"), F.col("_n"))), F.lit(0))
        counts = out.select("k").crossJoin(found.withColumnRenamed("k", "_k")).groupBy("k").agg(upto.alias(name))  # ks by at most max(ks) rows
        out = out.join(counts, "k", "left").crossJoin(picked.agg(F.count("*").alias(total))).na.fill(0, [name])  # one row
    return out.select("k", "attacks", "success", "controls", "control_success", "baseline")


def inference(targets: DataFrame, synthetic: DataFrame, keys: list[str], secret: str, tolerance: float | None = None, id_column: str = "id") -> DataFrame:
    """One row: targets, and hits, those whose secret the nearest synthetic row by the keys has (or comes near, within a relative tolerance)."""
    near = k_nearest(targets, synthetic, keys, 1, id_column=id_column)
    x = near.join(targets.select(F.col(id_column).alias("id"), F.col(secret).alias("_t")), "id").join(synthetic.select(F.col(id_column).alias("other"), F.col(secret).alias("_g")), "other")
    good = F.col("_t") == F.col("_g") if tolerance is None else F.abs(F.col("_t") - F.col("_g")) <= F.abs(F.col("_t")) * tolerance
    return x.agg(F.count("*").alias("targets"), F.count_if(F.coalesce(good, F.lit(False))).alias("hits"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The middle and half width of the Wilson interval of a success rate."""
    p = F.try_divide(hits, n)
    return (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))


def attack_risk(rates: DataFrame, attack: str = "success", control: str = "control", n: str = "attacks") -> DataFrame:
    """rates with rate, margin and risk, (rate - control rate) / (1 - control rate), not below 0."""
    rate, margin = wilson(F.col(attack), F.col(n))
    base, _ = wilson(F.col(control), F.col(n))
    return rates.withColumns({"rate": rate, "margin": margin, "risk": F.greatest(F.try_divide(rate - base, 1 - base), F.lit(0.0))})


def rank_auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """One row: auc, the share of (positive, negative) pairs in which the positive has the larger score, ties half; from counts by score."""
    return counts_auc(df.groupBy(F.col(score).cast("double").alias("_s")).agg(F.sum(label.cast("long")).alias("pos"), F.sum((~label).cast("long")).alias("neg")))


def counts_auc(counts: DataFrame) -> DataFrame:
    """The same from counts by score (_s, pos, neg)."""
    x = running(counts.select(F.lit(0).alias("_g"), "_s", "pos", "neg"), "_g", "_s", ["neg"])
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2)
    return x.agg(F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def log_density(df: DataFrame, points: DataFrame, columns: list[str], name: str) -> DataFrame:
    """points with the log density of the independent normals fitted on df."""
    s = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    d = F.lit(0.0)
    for c in columns:
        z = (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-10)
        d = d - z * z / 2 - F.ln(F.col(f"_s_{c}") + 1e-10) - 0.5 * math.log(2 * math.pi)
    return points.crossJoin(F.broadcast(s)).select(*points.columns, d.alias(name))  # one row


def membership(train: DataFrame, hold: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """One row: auc and accuracy (at the median) of the attack that scores rows by their density in the synthetic table over that in the hold-out; members are train rows."""
    x = train.select(*columns, F.lit(True).alias("member")).unionByName(hold.select(*columns, F.lit(False).alias("member")))
    x = log_density(hold, log_density(synthetic, x, columns, "_p"), columns, "_q").withColumn("score", F.round(F.col("_p") - F.col("_q"), 9))
    cut = quantiles(x, [], "score", [0.5]).select(F.col("q")[0].alias("cut"))
    accuracy = x.crossJoin(F.broadcast(cut)).agg(F.avg(((F.col("score") > F.col("cut")) == F.col("member")).cast("double")).alias("accuracy"))  # one row
    return rank_auc(x, F.col("member"), "score").crossJoin(accuracy)  # one row each


def kernel_membership(points: DataFrame, synthetic: DataFrame, columns: list[str], radius: float) -> DataFrame:
    """id, density: how many synthetic rows lie within the radius of each point (id, columns); 0 where a column is NULL. Whole cells of a kd tree are counted, not joined."""
    from tabveil.operators.densities import count_within

    hits = count_within(points, synthetic, columns, radius).select("id", F.col("n").alias("density"))
    return points.select("id").join(hits, "id", "left").select("id", F.coalesce("density", F.lit(0)).alias("density"))


def replicated(df: DataFrame, key: str, metric: Callable[[DataFrame], DataFrame], replicates: int = 10, share: float = 0.15) -> DataFrame:
    """mean and deviation of a metric's columns over hash samples of the rows; each sample is a job of its own over the whole table: where the metric is made of aggregates, over_replicates takes one scan."""
    out = None
    for i in range(replicates):
        one = metric(df.where(unit_hash(i, F.col(key)) < share)).withColumn("_r", F.lit(i))
        out = one if out is None else out.unionByName(one)
    names = [c for c in out.columns if c != "_r"]
    return out.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
