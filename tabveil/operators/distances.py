"""How far a synthetic table is from a real one: (column, value) rows for one column, (a, b, value) for pairs, one value for whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.operators.codes import quantiles, running
from tabveil.operators.joins import paired_shares
from tabveil.operators.neighbours import k_nearest
from tabveil.session import materialise
from tabveil.operators.sampling import pair_frequencies


def listwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows known in all the columns."""
    return df.select(*columns).na.drop("any")


def taken(df: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    """The columns, without unknown values: "listwise" leaves out rows with NULL or NaN in any of them, "columnwise" these values only."""
    if nulls == "listwise":
        return listwise(df, columns)
    if nulls != "columnwise":
        raise ValueError(f"nulls is listwise or columnwise, not {nulls}")
    real = {c for c, t in df.select(*columns).dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in columns])


def by_column(x: DataFrame, value: Column) -> DataFrame:
    return x.groupBy("column").agg(value.alias("value"))


def kl_discrete(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    """Sum of p ln(p / q) over the categories of either table; infinite where a real category is lacking."""
    p, q = F.col("p"), F.col("q")
    return by_column(paired_shares(taken(real, columns, nulls), taken(synthetic, columns, nulls), columns), F.sum(F.when(p == 0, 0.0).when(q == 0, float("inf")).otherwise(p * F.ln(F.try_divide(p, q)))))


def chi2_proportion(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    """Sum of (p - q)**2 / q, on shares; infinite where a real category is lacking."""
    p, q = F.col("p"), F.col("q")
    return by_column(paired_shares(taken(real, columns, nulls), taken(synthetic, columns, nulls), columns), F.sum(F.when(q == 0, float("inf")).otherwise(F.try_divide((p - q) * (p - q), q))))


def chi2_counts(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    """column, statistic, degrees, contingency: the test that shares are too small for.

    The statistic adds up (n - e)**2 / e, where n are the real counts and e what as many rows would have by the synthetic
    shares; it is infinite where a real category is lacking. degrees is one less than the categories of either table;
    contingency is sqrt(statistic / (statistic + n)), 0 for equal shares, whatever the number of rows.
    """
    x = paired_shares(taken(real, columns, nulls), taken(synthetic, columns, nulls), columns)
    share = F.try_divide((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    x = x.groupBy("column").agg(F.sum(F.when(F.col("q") == 0, float("inf")).otherwise(share)).alias("s"), F.sum("n").alias("n"), (F.count("*") - 1).alias("degrees"))
    mean = F.when(F.col("s") == float("inf"), 1.0).otherwise(F.sqrt(F.col("s") / (F.col("s") + 1)))
    return x.select("column", (F.col("s") * F.col("n")).alias("statistic"), "degrees", mean.alias("contingency"))


def dwp_discrete(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over the real categories of |p - q| / sqrt(2)."""
    return by_column(paired_shares(real, synthetic, columns).where("n > 0"), F.avg(F.abs(F.col("p") - F.col("q")) / math.sqrt(2)))


def jensen_shannon(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """The distance (root of the divergence), base 2."""
    part = lambda a, m: F.when(a > 0, a * F.log2(F.try_divide(a, m))).otherwise(0.0)
    m = (F.col("p") + F.col("q")) / 2
    return by_column(paired_shares(real, synthetic, columns), F.sqrt(F.greatest(F.sum(part(F.col("p"), m) + part(F.col("q"), m)) / 2, F.lit(0.0))))


def total_variation(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    return by_column(paired_shares(real, synthetic, columns), F.sum(F.abs(F.col("p") - F.col("q"))) / 2)


def moments(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """One row: counts, means, deviations, skews, kurtoses, sums, least and largest of each column."""
    kinds = {"n": F.count, "mean": F.avg, "pop": F.stddev_pop, "var": F.var_samp, "skew": F.skewness, "kurt": F.kurtosis, "sum": F.sum, "lo": F.min, "hi": F.max}
    return df.agg(F.array(*[F.struct(F.lit(c).alias("column"), *[f(F.col(c).cast("double")).alias(f"{side}_{k}") for k, f in kinds.items()]) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def both_moments(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    return moments(taken(real, columns, nulls), columns, "r").join(moments(taken(synthetic, columns, nulls), columns, "s"), "column")


def kl_normal(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    """KL divergence of the two normals with each side's mean and population deviation."""
    x = both_moments(real, synthetic, columns, nulls)
    d = F.col("r_mean") - F.col("s_mean")
    return x.select("column", (F.ln(F.try_divide("s_pop", "r_pop")) + F.try_divide(F.col("r_pop") * F.col("r_pop") + d * d, 2 * F.col("s_pop") * F.col("s_pop")) - 0.5).alias("value"))


def dwp_continuous(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    return both_moments(real, synthetic, columns).select("column", (F.abs(F.col("r_mean") - F.col("s_mean")) / math.sqrt(2)).alias("value"))


def moment_loss(real: DataFrame, synthetic: DataFrame, columns: list[str], epsilon: float = 1e-6, weight: str | None = None) -> DataFrame:
    """Sum over k = 1..4 of (1 - (m_s + e) / (m_r + e))**2 / k: mean, variance, skew, kurtosis; weighted by the squared column sum on request."""
    x = both_moments(real, synthetic, columns)
    total = F.lit(0.0)
    for k, m in enumerate(("mean", "var", "skew", "kurt"), 1):
        r = 1 - F.try_divide(F.col(f"s_{m}") + epsilon, F.col(f"r_{m}") + epsilon)
        total = total + r * r / k
    return x.select("column", (total * F.col("r_sum") * F.col("r_sum") if weight == "squared_sum" else total).alias("value"))


def normalised_moments(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Sum over k of |m_s / sum m_s - m_r / sum m_r| / k, sums over the columns."""
    x = both_moments(real, synthetic, columns)
    names = [f"{s}_{m}" for s in "rs" for m in ("mean", "var", "skew", "kurt")]
    x = x.crossJoin(F.broadcast(x.agg(*[F.sum(n).alias(f"all_{n}") for n in names])))  # one row
    total = F.lit(0.0)
    for k, m in enumerate(("mean", "var", "skew", "kurt"), 1):
        total = total + F.abs(F.try_divide(f"s_{m}", f"all_s_{m}") - F.try_divide(f"r_{m}", f"all_r_{m}")) / k
    return x.select("column", total.alias("value"))


def moment_differences(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """column, mean, var, skew, kurt: absolute differences."""
    return both_moments(real, synthetic, columns).select("column", *[F.abs(F.col(f"r_{m}") - F.col(f"s_{m}")).alias(m) for m in ("mean", "var", "skew", "kurt")])


def sum_shares(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """One value: the sum of the differences of the columns' shares of the grand total."""
    x = both_moments(real, synthetic, columns)
    x = x.crossJoin(F.broadcast(x.agg(F.sum("r_sum").alias("r"), F.sum("s_sum").alias("s"))))  # one row
    return x.agg(F.sum(F.abs(F.try_divide("r_sum", "r") - F.try_divide("s_sum", "s"))).alias("value"))


def distributions(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """column, v, previous, f, g: both distribution functions at every value."""
    side = lambda d, n, m: d.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v").where("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias(n)).withColumn(m, F.lit(0).cast("long"))
    x = side(real, "n", "m").unionByName(side(synthetic, "m", "n")).groupBy("column", "v").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    x = running(x, "column", "v", ["n", "m"])
    total = x.groupBy("column").agg(F.max("n_upto").alias("all_n"), F.max("m_upto").alias("all_m"))
    x = x.join(F.broadcast(total), "column")  # a row for each column name
    return x.select("column", "v", "previous", "n", "m", F.try_divide("n_upto", "all_n").alias("f"), F.try_divide("m_upto", "all_m").alias("g"), "all_n", "all_m")


def kolmogorov_smirnov(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    return by_column(distributions(taken(real, columns, nulls), taken(synthetic, columns, nulls), columns), F.max(F.abs(F.col("f") - F.col("g"))))


def wasserstein(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """First Wasserstein distance after scaling both by the real column's range."""
    x = distributions(real, synthetic, columns)
    before = lambda f, n, a: F.col(f) - F.try_divide(F.col(n), F.col(a))
    area = F.abs(before("f", "n", "all_n") - before("g", "m", "all_m")) * (F.col("v") - F.col("previous"))
    ends = F.max(F.when(F.col("n") > 0, F.col("v"))) - F.min(F.when(F.col("n") > 0, F.col("v")))
    return by_column(x, F.try_divide(F.sum(F.coalesce(area, F.lit(0.0))), ends))


def pearson_pairs(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    """a, b, r, s: both tables' correlations."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    of = lambda d, n: taken(d, columns, nulls).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(n)) for a, b in pairs]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return of(real, "r").join(of(synthetic, "s"), ["a", "b"])


def known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def pearson_difference(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    """a, b, value: |r - s|; a pair without both correlations is skipped."""
    return pearson_pairs(real, synthetic, columns, nulls).where(known(F.col("r")) & known(F.col("s"))).select("a", "b", F.abs(F.col("r") - F.col("s")).alias("value"))


def correlation_distance(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """One value: the mean of |R - S| over the full matrices, unknown correlations 0."""
    zero = lambda c: F.when(known(F.col(c)), F.col(c)).otherwise(0.0)
    pairs = pearson_pairs(real, synthetic, columns).agg((2 * F.sum(F.abs(zero("r") - zero("s")))).alias("off"))
    varies = lambda d, n: listwise(d, columns).agg(F.array(*[(F.stddev_pop(c) > 0).cast("int") for c in columns]).alias(n))
    diagonal = varies(real, "x").crossJoin(varies(synthetic, "y")).select(F.aggregate(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b).alias("diagonal"))  # one row each
    return pairs.crossJoin(diagonal).select(((F.col("off") + F.col("diagonal")) / len(columns) ** 2).alias("value"))


def correlation_loss(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """One value: the mean squared difference of the off-diagonal cross-products of columns scaled by mean and sample deviation + 1e-5."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def of(d: DataFrame, n: str) -> DataFrame:
        d = listwise(d, columns)
        z = lambda a, b: F.covar_pop(a, b) / ((F.stddev_samp(a) + 1e-5) * (F.stddev_samp(b) + 1e-5))
        return d.agg(F.array(*[z(a, b) for a, b in pairs]).alias(n))

    x = of(real, "x").crossJoin(of(synthetic, "y"))  # one row each
    return x.select((F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b) / len(pairs)).alias("value"))


def cramers_v(df: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    """a, b, v for each pair of discrete columns; NULL where a column has one value."""
    x = pair_frequencies(taken(df, columns, nulls), columns).where("a IS NOT NULL AND b IS NOT NULL")
    keys = ["column_a", "column_b"]
    rows, cols = x.groupBy(*keys, "a").agg(F.sum("n").alias("ra")), x.groupBy(*keys, "b").agg(F.sum("n").alias("cb"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("r"), F.sum("ra").alias("n_all")).join(cols.groupBy(*keys).agg(F.count("*").alias("c")), keys)
    # chi2 = n (sum of n_ab**2 / (r_a c_b) - 1)
    s = x.join(rows, [*keys, "a"]).join(cols, [*keys, "b"]).groupBy(*keys).agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("s"))
    v = F.sqrt(F.try_divide(F.greatest(F.col("s") - 1, F.lit(0.0)), F.least("r", "c") - 1))
    return s.join(sizes, keys).select(F.col("column_a").alias("a"), F.col("column_b").alias("b"), v.alias("v"))


def cramers_difference(real: DataFrame, synthetic: DataFrame, columns: list[str], nulls: str = "listwise") -> DataFrame:
    x = cramers_v(real, columns, nulls).join(cramers_v(synthetic, columns, nulls).withColumnRenamed("v", "w"), ["a", "b"])
    return x.where("v IS NOT NULL AND w IS NOT NULL").select("a", "b", F.abs(F.col("v") - F.col("w")).alias("value"))


def correlation_ratio(df: DataFrame, category: str, measure: str) -> DataFrame:
    """One value: the root of the share of the measure's variation between categories."""
    g = df.where(F.col(category).isNotNull() & F.col(measure).isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.avg(measure).alias("m"), F.var_pop(measure).alias("v"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")
    return g.agg(F.sqrt(F.try_divide(between, between + F.sum(F.col("n") * F.col("v")))).alias("value"))


def associations(df: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    """a, b, v of all pairs: Cramer's V, correlation, correlation ratio."""
    out = cramers_v(df, discrete)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("v")) for i, a in enumerate(continuous) for b in continuous[i + 1 :]]
    if pairs:
        out = out.unionByName(df.agg(F.array(*pairs).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    for a in discrete:
        for b in continuous:
            out = out.unionByName(correlation_ratio(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("value").alias("v")))
    return out


def association_distance(real: DataFrame, synthetic: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    """One value: the Frobenius norm of the difference of both association matrices."""
    x = associations(real, discrete, continuous).join(associations(synthetic, discrete, continuous).withColumnRenamed("v", "w"), ["a", "b"])
    d = F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))
    return x.agg(F.sqrt(2 * F.sum(d * d)).alias("value"))


def column_shapes(real: DataFrame, synthetic: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    return kolmogorov_smirnov(real, synthetic, continuous).unionByName(total_variation(real, synthetic, discrete)).select("column", (1 - F.col("value")).alias("value"))


def pair_trends(real: DataFrame, synthetic: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    """a, b, value: 1 - |r - s| / 2 for numbers, 1 - total variation of the joint shares for categories."""
    numbers = pearson_difference(real, synthetic, continuous).select("a", "b", (1 - F.col("value") / 2).alias("value"))
    keys = ["column_a", "column_b", "a", "b"]

    def joint(d: DataFrame, n: str) -> DataFrame:
        x = pair_frequencies(listwise(d, discrete), discrete)
        total = x.groupBy("column_a", "column_b").agg(F.sum("n").alias("_all"))
        return x.join(F.broadcast(total), ["column_a", "column_b"]).select(*keys, (F.col("n") / F.col("_all")).alias(n))  # a row for each pair of columns

    x = joint(real, "p").join(joint(synthetic, "q"), keys, "full")
    tv = F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2
    return numbers.unionByName(x.groupBy(F.col("column_a").alias("a"), F.col("column_b").alias("b")).agg((1 - tv).alias("value")).select("a", "b", "value"))


def coverage(real: DataFrame, synthetic: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    """Share of the real range, or of the real categories, that the synthetic column reaches."""
    x = moments(real, continuous, "r").join(moments(synthetic, continuous, "s"), "column")
    width = F.col("r_hi") - F.col("r_lo")
    low = F.greatest(F.try_divide(F.col("s_lo") - F.col("r_lo"), width), F.lit(0.0))
    high = F.greatest(F.try_divide(F.col("r_hi") - F.col("s_hi"), width), F.lit(0.0))
    numbers = x.select("column", F.greatest(1 - low - high, F.lit(0.0)).alias("value"))
    return numbers.unionByName(by_column(paired_shares(real, synthetic, discrete).where("n > 0"), F.avg((F.col("m") > 0).cast("double"))))


def precision_recall(real: DataFrame, synthetic: DataFrame, columns: list[str], k: int = 5, id_column: str = "id") -> DataFrame:
    """One row: precision, recall, density, coverage by balls to the k-th neighbour. Both tables must be samples of bounded size.

    A synthetic row counts for precision where it lies within the ball of some real row, and for recall the other way.
    """
    radius = lambda d: k_nearest(d, d, columns, k, id_column=id_column, exclude_self=True).where(F.col("rank") == k).select("id", F.col("distance").alias("r"))
    whole = lambda d: d.select(F.col(id_column).alias("id"), *columns)
    a, b = radius(real), radius(synthetic)
    hits = within(whole(real).join(a, "id"), whole(synthetic), columns)
    back = within(whole(synthetic).join(b, "id"), whole(real), columns)
    count = lambda d, name: d.agg(F.count("*").alias(name))
    x = count(hits.select("other").distinct(), "p").crossJoin(count(back.select("other").distinct(), "c")).crossJoin(count(hits, "h")).crossJoin(count(hits.select("id").distinct(), "v")).crossJoin(count(real, "n")).crossJoin(count(synthetic, "m"))  # one row each
    return x.select((F.col("p") / F.col("m")).alias("precision"), (F.col("c") / F.col("n")).alias("recall"), (F.col("h") / (k * F.col("m"))).alias("density"), (F.col("v") / F.col("n")).alias("coverage"))


def within(balls: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """id, other: the points within each ball (id, columns, r), ball by ball in a range join on the first column.

    Both sides are dealt by cells of the first column as wide as the largest radius; a ball meets the cells that it
    reaches into.
    """
    wide = balls.agg(F.max("r").alias("w")).first()[0] or 1.0
    cell = lambda c: F.floor(c / wide).cast("long")
    first = columns[0]
    x = balls.withColumn("_cell", F.explode(F.sequence(cell(F.col(first) - F.col("r")), cell(F.col(first) + F.col("r")))))
    y = points.select(F.col("id").alias("other"), *[F.col(c).alias(f"_{c}") for c in columns]).withColumn("_cell", cell(F.col(f"_{first}")))
    d = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in columns), F.lit(0.0))
    return x.join(y, "_cell").where(F.sqrt(d) <= F.col("r")).select("id", "other")


def alpha_precision(real: DataFrame, synthetic: DataFrame, columns: list[str], alphas: int = 10) -> DataFrame:
    """alpha, share: of the synthetic rows within the ball around the real centre that holds a share alpha of the real rows."""
    centre = real.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    d = F.sqrt(sum(((F.col(c) - F.col(f"_m_{c}")) * (F.col(c) - F.col(f"_m_{c}")) for c in columns), F.lit(0.0)))
    away = lambda t: t.select(*columns).crossJoin(F.broadcast(centre)).select(d.alias("d"))  # noqa: E731  one row
    steps = [i / alphas for i in range(1, alphas + 1)]
    cuts = quantiles(away(real), [], "d", steps).select("q")
    share = F.array(*[F.avg((F.col("d") <= F.col("q")[i]).cast("double")) for i in range(alphas)])
    x = away(synthetic).crossJoin(F.broadcast(cuts)).agg(share.alias("x"))  # one row
    return x.select(F.posexplode("x").alias("i", "share")).select(((F.col("i") + 1) / alphas).alias("alpha"), "share")


def support_curves(real: DataFrame, synthetic: DataFrame, columns: list[str], steps: int = 30, id_column: str = "id") -> DataFrame:
    """alpha, precision, recall: for `steps` shares alpha from 0 to 1, how much of either table lies in the other's alpha support.

    Precision is the share of synthetic rows within the ball around the real centre that holds a share alpha of the
    real rows. Recall is the share of real rows that have a synthetic row no farther away than any other real row, this
    nearest synthetic row (of equal ones that of the smallest id) lying in the ball around the synthetic centre that
    holds a share alpha of these nearest rows. Rows at a ball's edge, up to rounding, are inside.
    """
    alphas = [i / (steps - 1) for i in range(steps)]

    def away(d: DataFrame, t: DataFrame) -> Column:
        """The distance from t's centre."""
        m = t.agg(*[F.avg(c).alias(c) for c in columns]).first()
        return F.sqrt(sum(((F.col(c) - F.lit(m[c])) * (F.col(c) - F.lit(m[c])) for c in columns), F.lit(0.0)))

    whole = lambda d: d.select(F.col(id_column).alias("id"), *columns).na.drop("any")
    a, b = whole(real), whole(synthetic)
    own = k_nearest(a, a, columns, 1, exclude_self=True).select("id", F.col("distance").alias("own"))
    near = k_nearest(a, b, columns, 1).select("id", "other", "distance").join(own, "id", "left")
    near = near.join(b.select(F.col("id").alias("other"), away(b, b).alias("d")), "other").select("d", (F.col("distance") <= F.coalesce("own", F.lit(float("inf")))).alias("covered"))
    near = materialise(near, "covered")
    balls = quantiles(a.select(F.lit("p").alias("kind"), away(a, a).alias("d")).unionByName(near.select(F.lit("r").alias("kind"), "d")), ["kind"], "d", alphas)
    cuts = balls.agg(*[F.max(F.when(F.col("_g.kind") == k, F.col("q"))).alias(k) for k in "pr"])
    inside = lambda d, k, hit: d.crossJoin(F.broadcast(cuts)).agg(F.array(*[F.avg(((F.col("d") <= F.col(k)[i] * (1 + 1e-12)) & hit).cast("double")) for i in range(steps)]).alias(k))  # noqa: E731  one row
    x = inside(b.select(away(b, a).alias("d")), "p", F.lit(True)).crossJoin(inside(near, "r", F.col("covered")))  # one row each
    return x.select(F.posexplode(F.arrays_zip(F.array(*map(F.lit, alphas)).alias("alpha"), "p", "r")).alias("i", "x")).select("x.alpha", F.col("x.p").alias("precision"), F.col("x.r").alias("recall"))


def support_scores(curves: DataFrame) -> DataFrame:
    """One row: precision and recall, 1 less the area between the curve of support_curves and the diagonal, relative to the diagonal's."""
    return curves.agg(*[(1 - F.sum(F.abs(F.col("alpha") - F.col(c))) / F.sum("alpha")).alias(c) for c in ("precision", "recall")])


def imputation_auc(imputed: DataFrame, truth: DataFrame, row: str, value: str) -> DataFrame:
    """One row: micro_f1 and auc of the votes of many imputed tables for each row's class.

    A row's score for a class is its share of the row's votes; of equal ones the smallest class is the guess. AUC is
    over all pairs of a row and a class that the truth has; pairs without votes are counted, not made. Votes for other
    classes, or NULL, count in the row's total alone; a row without votes has scores of 0 and its guess is the smallest class.
    """
    from tabveil.operators.privacy import counts_auc

    t = truth.where(F.col(value).isNotNull()).select(F.col(row).alias("_row"), F.col(value).alias("_true"))
    classes = t.select(F.col("_true").alias("_class")).distinct()
    votes = imputed.groupBy(F.col(row).alias("_row"), F.col(value).alias("_class")).agg(F.count("*").alias("n"))
    total = votes.groupBy("_row").agg(F.sum("n").alias("all"))
    shares = votes.join(classes, "_class", "left_semi").join(total, "_row").join(t, "_row").select("_row", "_class", "_true", (F.col("n") / F.col("all")).alias("_s"))
    shares = materialise(shares, "votes")
    guess = shares.groupBy("_row").agg(F.min_by("_class", F.struct(-F.col("_s"), "_class")).alias("guess"))
    first = classes.agg(F.min("_class").alias("_first"))
    f1 = t.join(guess, "_row", "left").crossJoin(F.broadcast(first)).agg(F.avg((F.coalesce("guess", "_first") == F.col("_true")).cast("double")).alias("micro_f1"))  # one row
    hit = F.col("_class") == F.col("_true")
    counts = shares.groupBy("_s").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    size = t.agg(F.count("*").alias("rows")).crossJoin(classes.agg(F.count("*").alias("classes")))  # one row each
    rest = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg")).crossJoin(size)
    rest = rest.select(F.lit(0.0).alias("_s"), (F.col("rows") - F.col("pos")).alias("pos"), (F.col("rows") * (F.col("classes") - 1) - F.col("neg")).alias("neg"))
    return f1.crossJoin(counts_auc(counts.unionByName(rest)))  # one row each


def imputation_score(imputed: DataFrame, truth: DataFrame, row: str, value: str) -> DataFrame:
    """One value: the share of rows whose most frequent imputed class (ties to the smallest) is the true one; for single labels this is micro-F1."""
    votes = imputed.groupBy(row, value).agg(F.count("*").alias("n")).groupBy(row).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias("guess"))
    return truth.join(votes, row, "left").agg(F.avg(F.coalesce((F.col(value) == F.col("guess")), F.lit(False)).cast("double")).alias("value"))


def sample_score(real: DataFrame, synthetic: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    """One value: correlation distance + 10 * mean discrete DWP."""
    return correlation_distance(real, synthetic, continuous).withColumnRenamed("value", "c").crossJoin(dwp_discrete(real, synthetic, discrete).agg(F.avg("value").alias("d"))).select((F.col("c") + 10 * F.col("d")).alias("value"))  # one row each
