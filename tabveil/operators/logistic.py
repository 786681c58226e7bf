"""Many logistic models fitted together: every Newton step of all of them is one scan.

A row carries the list of models that it trains. Each task sums up gradients and Hessians by model, so what leaves it
is of the models' and features' number, not of the rows'. Folds of a cross-validation, bags and several tables are
lists of different kinds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.operators.sampling import folds
from tabveil.operators.utility import classification_scores
from tabveil.session import materialise, ship


@dataclass
class Logistics:
    """Models on columns shifted by mean and divided by deviation, a row a model; the last coefficient is the intercept."""

    features: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    coefficients: np.ndarray

    def probabilities(self, df: DataFrame, name: str = "probabilities") -> DataFrame:
        """df with the probability of label 1 under each model, an array; NULL where a feature is not known."""
        values = [F.col(c).cast("double") for c in self.features]
        scale = np.hstack([self.coefficients[:, :-1] / self.deviation, (self.coefficients[:, -1] - (self.coefficients[:, :-1] * self.mean / self.deviation).sum(axis=1))[:, None]])
        one = [1 / (1 + F.exp(-sum((v * float(c) for v, c in zip(values, line, strict=False)), F.lit(float(line[-1]))))) for line in scale]
        known = F.forall(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v))
        return df.withColumn(name, F.when(known, F.array(*one)))


def fit_logistics(df: DataFrame, features: list[str], label: str, n_models: int, penalty: float = 0.01, steps: int = 30, tolerance: float = 1e-10) -> Logistics:
    """Models of label (0 or 1) on the features, each on the rows whose `models` (a list of numbers below n_models) name it.

    The two classes weigh the same in each model; the loss is the weighted mean plus penalty / 2 times the squared
    coefficients of standardised features. Rows not known in the label or a feature take no part. A model without rows
    of both classes has coefficients 0.
    """
    ship(df.sparkSession)
    width = len(features)
    whole = df.select("models", F.col(label).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    x = materialise(whole.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))), "training")
    parts = [f(F.get("x", i)).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    mean, deviation, weight = np.zeros((n_models, width)), np.ones((n_models, width)), np.zeros((n_models, 2))
    for r in x.select("x", "y", F.explode("models").alias("m")).groupBy("m").agg(F.count_if(F.col("y") == 0).alias("no"), F.count_if(F.col("y") == 1).alias("yes"), *parts).collect():  # a row a model
        mean[r.m] = [r[f"m{i}"] for i in range(width)]
        deviation[r.m] = [r[f"s{i}"] or 1.0 for i in range(width)]
        if r.no and r.yes:
            weight[r.m] = 0.5 / r.no, 0.5 / r.yes  # both add up to 1
    coefficients, ridge = np.zeros((n_models, width + 1)), np.diag([penalty] * width + [0.0])
    for _ in range(steps):
        at = coefficients.copy()

        def add(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_models, width + 1, width + 2))
            for b in batches:
                rows = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                y, lists = b.column(1).to_numpy(), b.column(0)
                row, model = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
                for m in np.unique(model):
                    mine = row[model == m]
                    z = np.hstack([(rows[mine] - mean[m]) / deviation[m], np.ones((len(mine), 1))])
                    p, w = 1 / (1 + np.exp(-z @ at[m])), weight[m][y[mine]]
                    total[m, :, :-1] += (z * (w * p * (1 - p))[:, None]).T @ z
                    total[m, :, -1] += z.T @ (w * (p - y[mine]))
            flat = total.reshape(n_models, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_models), pa.int32()), pa.array(flat.tolist(), pa.list_(pa.float64()))], ["m", "v"])

        sums = x.select("models", "y", "x").mapInArrow(add, "m int, v array<double>").select("m", F.posexplode("v").alias("i", "v")).groupBy("m", "i").agg(F.sum("v").alias("v"))
        total = np.zeros((n_models, (width + 1) * (width + 2)))
        for r in sums.collect():  # models by squared features
            total[r.m, r.i] = r.v
        moved = 0.0
        for m, t in enumerate(total.reshape(n_models, width + 1, width + 2)):
            if weight[m].any():
                step = np.linalg.solve(t[:, :-1] + ridge, t[:, -1] + ridge @ coefficients[m])
                coefficients[m] -= step
                moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return Logistics(features, mean, deviation, coefficients)


def fold_logistics(df: DataFrame, fold: Column, features: list[str], label: str, k: int) -> Logistics:
    """Model i is trained on all folds but i."""
    return fit_logistics(df.withColumn("models", F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != fold)), features, label, k)


def scores_by(df: DataFrame, group: str, n: int) -> list[DataFrame]:
    """classification_scores of df (label, prediction) for each group 0..n-1; from one scan of df."""
    counts = materialise(df.groupBy(group, F.col("label").alias("y"), F.col("prediction").alias("g")).agg(F.count("*").alias("n")), "confusion")
    return [classification_scores(counts.where(F.col(group) == i).select("y", "g", "n")) for i in range(n)]


def cross_validation(df: DataFrame, key: str, features: list[str], label: str, k: int = 5) -> DataFrame:
    """metric, value with metrics named fold<i>_<metric>, of logistic models fitted together on all but one of k hashed folds each.

    Rows not known in a feature or the label take no part.
    """
    x = materialise(folds(df, [key], k), "folds")
    models = fold_logistics(x, F.col("fold"), features, label, k)
    told = models.probabilities(x.where(F.col(label).isNotNull())).where("probabilities IS NOT NULL")
    told = told.select("fold", F.col(label).cast("double").alias("label"), (F.get("probabilities", F.col("fold").cast("int")) >= 0.5).cast("double").alias("prediction"))
    out = None
    for i, s in enumerate(scores_by(told, "fold", k)):
        one = s.unpivot([], s.columns, "metric", "value").withColumn("metric", F.concat(F.lit(f"fold{i}_"), "metric"))
        out = one if out is None else out.unionByName(one)
    return out


def bagged(train: DataFrame, test: DataFrame, bag: Column, features: list[str], label: str, bags: int = 3) -> DataFrame:
    """test with label, score (the mean probability of models fitted on one bag each) and prediction."""
    models = fit_logistics(train.withColumn("models", F.array(bag.cast("int"))), features, label, bags)
    mean = F.aggregate("_p", F.lit(0.0), lambda s, v: s + v) / bags
    x = models.probabilities(test, "_p").withColumn("score", mean).withColumns({"label": F.col(label).cast("double"), "prediction": (F.col("score") >= 0.5).cast("double")})
    return x.where("score IS NOT NULL").drop("_p")
