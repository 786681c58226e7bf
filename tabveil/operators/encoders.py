"""Reversible encoders: fit learns a small state, transform and inverse are lazy projections."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import date_to_days, days_to_date, normal_cdf, normal_quantile, unit_hash
from tabveil.operators.codes import category_codes, quantiles, running


class Encoder:
    """fit(df) -> self, transform(df), inverse(df); other columns pass through."""

    def fit(self, df: DataFrame) -> Encoder:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def inverse(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class DateEncoder(Encoder):
    """Dates as days since 1800-01-01 and back."""

    columns: list[str]

    def transform(self, df):
        return df.withColumns({c: date_to_days(F.col(c)) for c in self.columns})

    def inverse(self, df):
        return df.withColumns({c: days_to_date(F.col(c)) for c in self.columns})


@dataclass
class MissingEncoder(Encoder):
    """NULL as a token in discrete columns; in continuous ones the median (plus noise by hash of the key) and a flag <c>_missing."""

    discrete: list[str]
    continuous: list[str]
    token: str = "_missing_"
    noise: float = 0.0
    key: str | None = None
    medians: dict[str, float] = field(default_factory=dict)

    def fit(self, df):
        row = df.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in self.continuous]).first()
        gaps = [c for c in self.continuous if row[c]]
        q = column_quantiles(df, gaps, [0.5])
        self.medians = {c: q[c][0] if c in q else None for c in gaps}
        return self

    def transform(self, df):
        flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in self.medians}
        df = df.withColumns(flags) if flags else df
        spread = lambda c: self.noise * (unit_hash(1, F.lit(c), F.col(self.key)) + unit_hash(2, F.lit(c), F.col(self.key)) - 1) if self.noise else F.lit(0.0)
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m) + spread(c)) for c, m in self.medians.items()}
        return df.withColumns(filled | {c: F.coalesce(F.col(c).cast("string"), F.lit(self.token)) for c in self.discrete})

    def inverse(self, df):
        back = {c: F.when(F.col(f"{c}_missing") < 0.5, F.col(c)) for c in self.medians}
        return df.withColumns(back | {c: F.when(F.col(c) != self.token, F.col(c)) for c in self.discrete}).drop(*[f"{c}_missing" for c in self.medians])


@dataclass
class Imputer(Encoder):
    """NULL as the train table's mean (numbers) or most frequent value (ties to the smallest)."""

    mean: list[str]
    frequent: list[str]
    values: dict[str, object] = field(default_factory=dict)

    def fit(self, df):
        row = df.agg(*[F.avg(c).alias(c) for c in self.mean], *[F.mode(c, True).alias(c) for c in self.frequent]).first()
        self.values = {c: row[c] for c in [*self.mean, *self.frequent] if row[c] is not None}
        return self

    def transform(self, df):
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


#: Pairs of values that count as no / yes.
PAIRS = (("0", "1"), ("false", "true"), ("no", "yes"), ("n", "y"), ("f", "m"), ("0.0", "1.0"))


@dataclass
class BinaryEncoder(Encoder):
    """Known pairs of values (any case), or -1 and another, as 0 and 1; anything else raises. The inverse cuts at 0.5."""

    columns: list[str]
    pairs: dict[str, tuple[str, str]] = field(default_factory=dict)

    def fit(self, df):
        for c in self.columns:
            seen = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(3).collect())
            low = {v.lower(): v for v in seen}
            pair = next(((low[a], low[b]) for a, b in PAIRS if set(low) == {a, b}), None)
            if pair is None and len(seen) == 2 and "-1" in seen:
                pair = ("-1", next(v for v in seen if v != "-1"))
            if pair is None:
                raise ValueError(f"{c} isn't binary: {seen}")
            self.pairs[c] = pair
        return self

    def transform(self, df):
        return df.withColumns({c: F.when(F.col(c).cast("string") == b, 1).when(F.col(c).cast("string") == a, 0) for c, (a, b) in self.pairs.items()})

    def inverse(self, df):
        return df.withColumns({c: F.when(F.col(c) >= 0.5, b).when(F.col(c) < 0.5, a) for c, (a, b) in self.pairs.items()})


@dataclass
class LabelEncoder(Encoder):
    """Values by their number in sorted order, as doubles; one dictionary for each column, or one for all (shared). Unseen values get the number after the last."""

    columns: list[str]
    shared: bool = False
    tables: dict[str, DataFrame] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)

    def fit(self, df):
        text = df.select([F.col(c).cast("string").alias(c) for c in self.columns])
        if self.shared:
            one = category_codes(text.unpivot([], self.columns, "column", "value"), "value")
            self.tables = {c: one for c in self.columns}
        else:
            self.tables = {c: category_codes(text, c) for c in self.columns}
        counts = {id(t): t for t in self.tables.values()}
        n = {k: t.count() for k, t in counts.items()}
        self.sizes = {c: n[id(t)] for c, t in self.tables.items()}
        return self

    def transform(self, df):
        order = df.columns
        for c, t in self.tables.items():
            codes = t.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            df = df.join(codes, F.col(c).cast("string") == F.col("_value"), "left").withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("_code", F.lit(self.sizes[c])).cast("double"))).select(order)
        return df

    def inverse(self, df):
        order = df.columns
        for c, t in self.tables.items():
            codes = t.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            df = df.join(codes, F.round(c).cast("long") == F.col("_code"), "left").withColumn(c, F.col("_value")).select(order)
        return df


@dataclass
class OneHotEncoder(Encoder):
    """A 0/1 column <c>=<v> for each category (at most `most`); unseen values have all 0; the inverse takes the first largest."""

    columns: list[str]
    most: int = 200
    values: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, df):
        for c in self.columns:
            seen = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(self.most + 1).collect())
            if len(seen) > self.most:
                raise ValueError(f"{c} has more than {self.most} categories")
            self.values[c] = seen
        return self

    def transform(self, df):
        hot = {f"{c}={v}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for c, vs in self.values.items() for v in vs}
        return df.withColumns(hot).drop(*self.columns)

    def inverse(self, df):
        for c, vs in self.values.items():
            x = F.array(*[F.col(f"`{c}={v}`") for v in vs])
            df = df.withColumn(c, F.when(F.array_max(x) > 0, F.element_at(F.array(*map(F.lit, vs)), F.array_position(x, F.array_max(x)).cast("int")))).drop(*[f"{c}={v}" for v in vs])
        return df


def leave_one_out(train: DataFrame, other: DataFrame, category: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with the category as the train mean of the target over its other rows; unseen categories get the overall mean."""
    sums = train.groupBy(category).agg(F.sum(target).alias("_s"), F.count(target).alias("_n")).withColumnRenamed(category, "_c")
    mean = train.agg(F.avg(target).alias("_m"))
    join = lambda d: d.join(sums, F.col(category).eqNullSafe(F.col("_c")), "left").crossJoin(F.broadcast(mean))  # noqa: E731  one row
    own = F.coalesce(F.try_divide(F.col("_s") - F.col(target), F.col("_n") - 1), F.col("_m"))
    a = join(train).withColumn(category, own).select(train.columns)
    b = join(other).withColumn(category, F.coalesce(F.try_divide("_s", "_n"), F.col("_m"))).select(other.columns)
    return a, b


@dataclass
class QuantileNormal(Encoder):
    """Values by the normal quantile of their rank, linear between at most `most` train quantiles; clipped at 1e-7 from 0 and 1, up to a billionth, which tells the ends from what is clipped."""

    columns: list[str]
    most: int = 1000
    edges: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df):
        steps = [i / (self.most - 1) for i in range(self.most)]
        self.edges = column_quantiles(df, self.columns, steps)
        return self

    def transform(self, df):
        return df.withColumns({c: to_normal(self.edges[c])(F.col(c).cast("double")) for c in self.columns})

    def inverse(self, df):
        return df.withColumns({c: from_normal(self.edges[c])(F.col(c).cast("double")) for c in self.columns})


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """The exact quantiles of each numeric column with known values; one row a column comes to the driver."""
    if not columns:
        return {}
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v")
    return {r.column: r.q for r in quantiles(long, ["column"], "v", shares).select("_g.column", "q").collect()}


#: Ranks nearer than CLIP to 0 or 1 get its score, less up to STEP; those that aren't the ends are taken for at least LEAST of CLIP.
CLIP, STEP, LEAST = 1e-7, 1e-9, 2e-5


@lru_cache(maxsize=1)
def _grid() -> tuple[np.ndarray, np.ndarray]:
    """Normal quantiles at a fine grid of probabilities, denser at the ends."""
    tail = np.logspace(-7, -2, 4000)
    p = np.unique(np.concatenate([tail, np.linspace(0.01, 0.99, 20001), 1 - tail]))
    normal = NormalDist()
    return p, np.array([normal.inv_cdf(float(x)) for x in p])


def to_normal(edges: list[float]):
    """A column function: the normal quantile of where a value lies among the edges."""
    x, share = np.array(edges), np.linspace(0, 1, len(edges))

    @F.pandas_udf("double")
    def place(v: pd.Series) -> pd.Series:
        a = v.to_numpy(dtype=float, na_value=np.nan)
        lo, hi = np.interp(a, x, share), 1 - np.interp(-a, -x[::-1], share)  # the middle of a flat stretch
        return pd.Series(np.where((a <= x[0]) | (a >= x[-1]), (lo + hi) / 2, np.clip((lo + hi) / 2, LEAST * CLIP, 1 - LEAST * CLIP))).where(~np.isnan(a), None)

    def score(v: Column) -> Column:
        p = place(v)
        below, above = (F.greatest(1 - q / CLIP, F.lit(0.0)) for q in (p, 1 - p))  # 0 unless clipped, 1 at the end
        return F.when(p.isNotNull(), normal_quantile(F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))) + (above - below) * STEP)

    return score


def from_normal(edges: list[float]):
    x, share = np.array(edges), np.linspace(0, 1, len(edges))

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        p, z = _grid()
        a = v.to_numpy(dtype=float, na_value=np.nan)
        at = np.interp(a, z, p)
        for end, beyond in ((0, z[0] - a), (1, a - z[-1])):  # what was clipped lies within STEP, the ends at its edge
            left = np.clip(1 - beyond / STEP, 0, 1)
            at = np.where(beyond >= 0, np.abs(end - np.where(left < LEAST / 2, 0, left * CLIP)), at)
        return pd.Series(np.interp(at, share, x)).where(~np.isnan(a), None)

    return run


def normal_distances(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, mean, deviation, distance: of each numeric column with known values, its moments and the Kolmogorov-Smirnov distance from the normal distribution that has them.

    Equal values are counted and the counts summed up over range partitions. A column without spread has distance 1.
    """
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    fit = long.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.count("*").alias("all"))
    x = running(long.groupBy("column", "v").agg(F.count("*").alias("n")), "column", "v", ["n"]).join(F.broadcast(fit), "column")  # a row a column
    below = normal_cdf(F.try_divide(F.col("v") - F.col("mean"), F.col("deviation")))
    gap = F.greatest(F.abs(F.col("n_upto") / F.col("all") - below), F.abs((F.col("n_upto") - F.col("n")) / F.col("all") - below))
    return x.groupBy("column", "mean", "deviation").agg(F.coalesce(F.max(gap), F.lit(1.0)).alias("distance"))


@dataclass
class MarginalNormal(Encoder):
    """Normal scores through a fitted marginal: z-scores where a column is nearer than `limit` to a normal distribution, else QuantileNormal.

    `fixed` names the marginal, "normal" or "empirical", of columns that aren't to choose. Both go back exactly, the
    ends of the train values included; scores beyond them give the ends where the marginal is empirical.
    """

    columns: list[str]
    limit: float = 0.05
    fixed: dict[str, str] = field(default_factory=dict)
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)
    distances: dict[str, float] = field(default_factory=dict)
    empirical: QuantileNormal | None = None

    def fit(self, df):
        self.moments, self.distances = {}, {}
        for r in normal_distances(df, self.columns).collect():  # a row a column
            self.distances[r.column] = r.distance
            if self.fixed.get(r.column, "normal" if r.distance < self.limit else "empirical") == "normal":
                self.moments[r.column] = (r.mean, r.deviation or 1.0)
        self.empirical = QuantileNormal([c for c in self.columns if c in self.distances and c not in self.moments]).fit(df)
        return self

    def transform(self, df):
        return self.empirical.transform(df.withColumns({c: (F.col(c).cast("double") - m) / s for c, (m, s) in self.moments.items()}))

    def inverse(self, df):
        return self.empirical.inverse(df.withColumns({c: F.col(c).cast("double") * s + m for c, (m, s) in self.moments.items()}))


@dataclass
class Scaler(Encoder):
    """standard: (x - mean) / population deviation; unit: to 0..1; symmetric: to -1..1, the inverse clipped; utility: log(max(x, 0.01)) where the least is not negative and the largest at least 1000, else 5 times unit."""

    columns: list[str]
    kind: str = "standard"
    stats: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)

    def fit(self, df):
        row = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in self.columns for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
        self.stats = {c: tuple(row[f"{n}_{c}"] for n in ("m", "s", "lo", "hi")) for c in self.columns}
        return self

    def _both(self, c: str) -> tuple[Column, Column]:
        x, (m, s, lo, hi) = F.col(c), self.stats[c]
        width = (hi - lo) or 1.0
        if self.kind == "standard":
            return (x - m) / (s or 1.0), x * (s or 1.0) + m
        if self.kind == "unit":
            return (x - lo) / width, x * width + lo
        if self.kind == "symmetric":
            return (x - lo) / width * 2 - 1, F.least(F.greatest((x + 1) / 2 * width + lo, F.lit(lo)), F.lit(hi))
        if lo >= 0 and hi >= 1000:
            return F.ln(F.greatest(x, F.lit(0.01))), F.exp(x)
        return 5 * (x - lo) / width, x * width / 5 + lo

    def transform(self, df):
        return df.withColumns({c: self._both(c)[0] for c in self.columns})

    def inverse(self, df):
        return df.withColumns({c: self._both(c)[1] for c in self.columns})


@dataclass
class Components(Encoder):
    """Principal components PC1, PC2, ... of the columns, as many as explain the share of variance; other columns stay."""

    columns: list[str]
    share: float = 0.9
    model: PCAModel | None = None
    mean: list[float] = field(default_factory=list)
    k: int = 0

    def fit(self, df):
        row = df.agg(*[F.avg(c).alias(c) for c in self.columns]).first()
        self.mean = [row[c] for c in self.columns]
        self.model = PCA(k=len(self.columns), inputCol="_x", outputCol="_pc").fit(self._vector(df))
        self.k = int(np.searchsorted(np.cumsum(self.model.explainedVariance.toArray()), self.share - 1e-12)) + 1
        return self

    def _vector(self, df):
        centred = [(F.col(c) - m).alias(f"_c_{c}") for c, m in zip(self.columns, self.mean, strict=True)]
        return VectorAssembler(inputCols=[f"_c_{c}" for c in self.columns], outputCol="_x").transform(df.select("*", *centred))

    def transform(self, df):
        x = self.model.transform(self._vector(df)).withColumn("_pc", vector_to_array("_pc"))
        return x.select(*[c for c in df.columns if c not in self.columns], *[F.col("_pc")[i].alias(f"PC{i + 1}") for i in range(self.k)])

    def inverse(self, df):
        pc = self.model.pc.toArray()
        back = {c: sum((F.col(f"PC{i + 1}") * float(pc[n, i]) for i in range(self.k)), F.lit(self.mean[n])) for n, c in enumerate(self.columns)}
        return df.withColumns(back).drop(*[f"PC{i + 1}" for i in range(self.k)])


@dataclass
class ModeEncoder(Encoder):
    """A number by the component of a Gaussian mixture that most likely holds it and (x - mean) / (4 deviation), clipped to 0.99; listed point values are modes of their own."""

    column: str
    most: int = 10
    points: tuple[float, ...] = ()
    least_weight: float = 0.005
    modes: list[tuple[float, float, float]] = field(default_factory=list)

    def fit(self, df):
        x = df.where(F.col(self.column).isNotNull() & ~F.col(self.column).isin(*self.points)) if self.points else df.where(F.col(self.column).isNotNull())
        model = GaussianMixture(k=self.most, seed=7, featuresCol="_x", maxIter=30).fit(VectorAssembler(inputCols=[self.column], outputCol="_x").transform(x.select(F.col(self.column).cast("double"))))
        found = [(w, float(g.mean[0]), float(g.cov.toArray()[0, 0]) ** 0.5) for w, g in zip(model.weights, [r for r in model.gaussians], strict=True)]
        self.modes = sorted((m, s or 1.0, w) for w, m, s in found if w > self.least_weight)
        return self

    def transform(self, df):
        x = F.col(self.column).cast("double")
        at = F.when(F.lit(False), F.lit(0))
        for i, p in enumerate(self.points):
            at = at.when(x == p, len(self.modes) + i)
        options = F.array(*[F.struct((-np.log(w / s) + ((x - m) / s) * ((x - m) / s) / 2).alias("cost"), F.lit(i).alias("i")) for i, (m, s, w) in enumerate(self.modes)])
        mode = F.when(x.isNotNull(), at.otherwise(F.array_min(options)["i"]))
        offset = F.lit(0.0)
        for i, (m, s, _) in enumerate(self.modes):
            offset = F.when(F.col(f"{self.column}_mode") == i, (x - m) / (4 * s)).otherwise(offset)
        df = df.withColumn(f"{self.column}_mode", mode)
        return df.withColumn(self.column, F.when(x.isNotNull(), F.least(F.greatest(offset, F.lit(-0.99)), F.lit(0.99))))

    def inverse(self, df):
        out = F.lit(None).cast("double")
        for i, (m, s, _) in enumerate(self.modes):
            out = F.when(F.col(f"{self.column}_mode") == i, F.col(self.column) * 4 * s + m).otherwise(out)
        for i, p in enumerate(self.points):
            out = F.when(F.col(f"{self.column}_mode") == len(self.modes) + i, F.lit(p)).otherwise(out)
        return df.withColumn(self.column, out).drop(f"{self.column}_mode")


@dataclass
class Pipeline(Encoder):
    """Named encoders, forward in order, fitted on what those before give, and backward in reverse."""

    steps: list[tuple[str, Encoder]]

    def fit(self, df):
        for _, e in self.steps:
            df = e.fit(df).transform(df)
        return self

    def transform(self, df):
        for _, e in self.steps:
            df = e.transform(df)
        return df

    def inverse(self, df):
        for _, e in self.steps[::-1]:
            df = e.inverse(df)
        return df
