"""Gaussian kernel densities of one table at the rows of another, and the membership attack that compares two of them.

Rows are turned so that the kernel is round. In one or two columns they are summed up by the cells of a grid of half a
bandwidth: the powers of their distances from the cell's middle give a series around the middle of each other cell, the
same for all points there (the fast Gauss transform). Rows and points are read once each, and the series' error is known.

Points whose sum is too small for that error, and all points in more columns or on too large a grid, go to the cells of
a kd tree. For a point, a cell's box bounds its share of the sum from below and above. Cells whose bounds are so near
that all of them together can't change the sum by more than a relative tolerance count with their mean; the point meets
the rows of the other cells one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.operators import cells as C
from tabveil.operators.codes import numbered, quantiles
from tabveil.session import materialise, ship

#: Numbers in the table of points by cells that a task holds at once.
CELLS_AT_ONCE = 1 << 20
#: Powers in a series and the grid's step in bandwidths; numbers in the series of all cells that the driver holds; rows whose powers a task holds.
POWERS, STEP, NUMBERS, ROWS_AT_ONCE = 16, 0.5, 1 << 22, 4096


def scott(rows: DataFrame, width: int) -> tuple[np.ndarray, float, int]:
    """The matrix that turns rows (x) so that the kernel has deviation 1, the kernel's integral in x, and the number of rows; bandwidths by Scott's rule."""
    x = [F.get("x", i) for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i + 1)]
    got = rows.agg(F.count("*").alias("n"), *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((width, width))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] if got[f"c{i}_{j}"] is not None else math.nan
    cov *= max(got.n, 1) ** (-2.0 / (width + 4))
    root = np.linalg.cholesky(cov)
    return np.linalg.inv(root), float(np.prod(np.diag(root)) * (2 * math.pi) ** (width / 2)), got.n


def turned(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """rows with x turned."""
    return rows.withColumn("x", F.array(*[sum((F.get("x", j) * float(v) for j, v in enumerate(line)), F.lit(0.0)) for line in turn]))


def grid(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row along each axis, and its place from the cell's middle."""
    cell = np.floor(x / STEP)
    return cell.astype(np.int64), x - (cell + 0.5) * STEP


def series_error() -> float:
    """What a series may lack of a kernel of 1, along one axis (by Cramer's bound of Hermite functions), and what rounding may do to it."""
    term = lambda a, b: 1.09 * (STEP / 2) ** (a + b) * math.exp(math.lgamma(a + b + 1) / 2 - math.lgamma(a + 1) - math.lgamma(b + 1))
    return sum(term(a, b) for a in range(3 * POWERS) for b in range(3 * POWERS) if max(a, b) >= POWERS) + 64 * 2.0**-52


def shifted(to: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The matrix that makes the powers of the rows in the cells of one axis a series around the middles of others: (to, power), (source, power)."""
    away = (to[:, None] - source[None, :]) * STEP
    far = np.abs(away) > 38  # less than the smallest double
    away[far] = 0
    he = [np.ones_like(away), away]
    for k in range(1, 2 * POWERS - 1):
        he.append(away * he[k] - k * he[k - 1])
    bell = np.where(far, 0, np.exp(-away * away / 2))
    fact = [math.factorial(k) for k in range(POWERS)]
    out = np.empty((len(to), POWERS, len(source), POWERS))
    for b in range(POWERS):
        for a in range(POWERS):
            out[:, b, :, a] = (-1) ** b * he[a + b] * bell / (fact[a] * fact[b])
    return out.reshape(len(to) * POWERS, len(source) * POWERS)


def series_sums(points: DataFrame, data: DataFrame, width: int) -> DataFrame | None:
    """points (turned: id, x) with about, the sum of the kernels of data's rows (turned), right up to series_error for each row; None where the grid is too large."""
    if width > 2:
        return None
    spark = points.sparkSession
    ship(spark)
    along = lambda d, side: d.select(F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(i).alias("axis"), F.floor(F.get("x", i) / STEP).cast("long").alias("cell")) for i in range(width)])).alias("v"))
    most = NUMBERS // POWERS**width
    told = along(points, 0).unionByName(along(data, 1)).select("v.*").distinct().limit(4 * most + 1).collect()
    axes = [[np.array(sorted(t.cell for t in told if (t.side, t.axis) == (side, i)), np.int64) for i in range(width)] for side in (0, 1)]
    if len(told) > 4 * most or max(math.prod(map(len, a)) for a in axes) > most or max(len(a) * len(b) for a, b in zip(*axes, strict=True)) * POWERS**2 > 4 * NUMBERS:
        return None
    to, source = axes

    def powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of the powers of a task's rows, by cell."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            whole = C.points_of(b.column(0), width)
            for lo in range(0, len(whole), ROWS_AT_ONCE):
                cell, at = grid(whole[lo : lo + ROWS_AT_ONCE])
                number = np.zeros(len(cell), np.int64)
                for i in range(width):
                    number = number * len(source[i]) + np.searchsorted(source[i], cell[:, i])
                order = np.argsort(number, kind="stable")
                number, at = number[order], at[order]
                begin = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                product = at[:, :1] ** np.arange(POWERS)
                for i in range(1, width):
                    product = (product[:, :, None] * (at[:, i : i + 1] ** np.arange(POWERS))[:, None, :]).reshape(len(at), -1)
                for k, v in zip(number[begin].tolist(), np.add.reduceat(product, begin), strict=True):
                    sums[k] = sums[k] + v if k in sums else v
        flat = np.concatenate([np.zeros(0), *sums.values()])
        edge = np.arange(len(sums) + 1, dtype=np.int32) * POWERS**width
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))], ["cell", "v"])

    def together(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).sum(axis=0)
        return pa.table([pa.array([t.column("cell")[0].as_py()], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["cell", "v"])

    parts = data.select("x").mapInArrow(powers, "cell long, v array<double>").groupBy("cell").applyInArrow(together, "cell long, v array<double>").toArrow()  # a row a cell, NUMBERS at most
    moments = np.zeros((math.prod(map(len, source)), POWERS**width))
    moments[parts.column("cell").to_numpy()] = C.points_of(parts.column("v"), POWERS**width)
    if width == 1:
        series = (shifted(to[0], source[0]) @ moments.reshape(-1, 1)).reshape(len(to[0]), POWERS)
    else:
        by_axis = moments.reshape(len(source[0]), len(source[1]), POWERS, POWERS).transpose(0, 2, 1, 3).reshape(len(source[0]) * POWERS, -1)
        series = shifted(to[0], source[0]) @ by_axis @ shifted(to[1], source[1]).T
        series = series.reshape(len(to[0]), POWERS, len(to[1]), POWERS).transpose(0, 2, 1, 3).reshape(-1, POWERS, POWERS)
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(series))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = C.points_of(b.column(1), width)
            about = np.zeros(len(whole))
            for lo in range(0, len(whole), ROWS_AT_ONCE):
                cell, at = grid(whole[lo : lo + ROWS_AT_ONCE])
                number = np.zeros(len(cell), np.int64)
                for i in range(width):
                    number = number * len(to[i]) + np.searchsorted(to[i], cell[:, i])
                v = sent.value[number]
                for i in range(width):  # each axis by Horner's rule
                    total = np.zeros((len(v), *v.shape[2:]))
                    for k in range(POWERS - 1, -1, -1):
                        total = total * at[:, i].reshape(-1, *[1] * (v.ndim - 2)) + v[:, k]
                    v = total
                about[lo : lo + ROWS_AT_ONCE] = v
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(about)], ["id", "x", "about"])

    return points.select("id", "x").mapInArrow(evaluate, "id long, x array<double>, about double")


def kernel_density(points: DataFrame, data: DataFrame, columns: list[str], id_column: str = "id", tolerance: float = 1e-9) -> DataFrame:
    """id, density: the Gaussian kernel density of data's rows at each point, right up to the relative tolerance.

    Ids differ within each table; rows with NULL or NaN take no part. The covariance of data must be regular: with
    fewer rows than columns, or a constant column, an error says so.
    """
    width = len(columns)
    points, data = C.numeric_rows(points, columns, id_column), C.numeric_rows(data, columns, id_column)
    turn, unit, n = scott(data, width)
    points, data = turned(points, turn), turned(data, turn)
    by_series = series_sums(points, data, width)
    if by_series is None:
        return sums_by_cells(points, data, width, n, tolerance).select("id", (F.col("part") / (n * unit)).alias("density"))
    by_series = materialise(by_series, "by-series")
    exact = F.col("about") * (tolerance / 2) >= width * n * series_error()
    out = by_series.where(exact).select("id", F.col("about").alias("part"))
    if (others := by_series.where(~exact).select("id", "x")).limit(1).count():
        out = out.unionByName(sums_by_cells(others, data, width, n, tolerance))
    return out.select("id", (F.col("part") / (n * unit)).alias("density"))


def sums_by_cells(points: DataFrame, data: DataFrame, width: int, n: int, tolerance: float) -> DataFrame:
    """id, part: the sum of the kernels of data's n rows (turned) at each point (turned: id, x), right up to the relative tolerance."""
    cells, placed = C.fit_cells(data, width)
    leaves = np.flatnonzero(cells.count)
    nodes, count, mean = cells.leaves + leaves, cells.count[leaves], cells.mean[leaves]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Points with about, the sum over the cells that count with their mean, and cell, those that don't."""
        some = max(1, CELLS_AT_ONCE // (len(nodes) * width))
        for b in batches:
            x = C.points_of(b.column(1), width)
            about, exact = np.zeros(len(x)), []
            for lo in range(0, len(x), some):
                p = x[lo : lo + some, None, :]
                most, least = (count * np.exp(-(d(nodes, p, 1.0, "l2") ** 2) / 2) for d in (cells.near, cells.far))
                allowed = tolerance * least.sum(axis=1)[:, None] * count / n
                by_mean = most - least <= allowed
                middle = count * np.exp(-((p - mean) ** 2).sum(axis=-1) / 2)
                about[lo : lo + some] = np.where(by_mean, middle, 0).sum(axis=1)
                exact += [leaves[~row].tolist() for row in by_mean]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(about), pa.array(exact, pa.list_(pa.int32()))], ["id", "x", "about", "cells"])

    weighed = materialise(points.select("id", "x").mapInArrow(weigh, "id long, x array<double>, about double, cells array<int>"), "weighed")

    def add(p: pa.Table, q: pa.Table) -> pa.Table:
        x, y = (C.points_of(t.column("x"), width) for t in (p, q))
        out = np.zeros(len(x))
        for lo in range(0, len(x) if len(y) else 0, 256):
            d = np.zeros((len(x[lo : lo + 256]), len(y)))
            for i in range(width):
                d += (x[lo : lo + 256, i, None] - y[:, i]) ** 2
            out[lo : lo + 256] = np.exp(-d / 2).sum(axis=1)
        return pa.table([p.column("id"), pa.array(out)], names=["id", "part"])

    sums, _ = C.meet(materialise(weighed.select("id", "x", F.explode("cells").alias("cell")), "asked"), placed, cells, add, "id long, part double", [F.col("id")])
    total = weighed.select("id", F.col("about").alias("part"))
    total = total if sums is None else total.unionByName(sums)
    return total.groupBy("id").agg(F.sum("part").alias("part"))


def count_within(points: DataFrame, data: DataFrame, columns: list[str], radius: float, id_column: str = "id") -> DataFrame:
    """id, n: how many of data's rows lie within the radius of each point, the edge included.

    Cells inside the ball count as they are; the point meets the rows of those that the edge passes through. Rows with
    NULL or NaN take no part; ids differ within each table.
    """
    width = len(columns)
    cells, placed = C.fit_cells(C.numeric_rows(data, columns, id_column), width)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sure, row, leaf = cells.inside(C.points_of(b.column(1), width), radius)
            edge = np.searchsorted(row, np.arange(len(sure) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sure), pa.ListArray.from_arrays(pa.array(edge), pa.array(leaf.astype(np.int32)))], ["id", "x", "sure", "cells"])

    walked = materialise(C.numeric_rows(points, columns, id_column).mapInArrow(walk, "id long, x array<double>, sure long, cells array<int>"), "walked")

    def add(p: pa.Table, q: pa.Table) -> pa.Table:
        x, y = (C.points_of(t.column("x"), width) for t in (p, q))
        out = np.zeros(len(x), np.int64)
        for lo in range(0, len(x) if len(y) else 0, 256):
            d = np.zeros((len(x[lo : lo + 256]), len(y)))
            for i in range(width):
                d += (x[lo : lo + 256, i, None] - y[:, i]) ** 2
            out[lo : lo + 256] = (np.sqrt(d) <= radius).sum(axis=1)
        return pa.table([p.column("id"), pa.array(out)], names=["id", "part"])

    sums, _ = C.meet(materialise(walked.select("id", "x", F.explode("cells").alias("cell")), "asked"), placed, cells, add, "id long, part long", [F.col("id")])
    total = walked.select("id", F.col("sure").alias("part"))
    total = total if sums is None else total.unionByName(sums)
    return total.groupBy("id").agg(F.sum("part").alias("n"))


def normal_density(points: DataFrame, data: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """id, density: of the independent normals fitted on data, over those of the columns that take at least ten values there."""
    kinds = data.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    wide = [c for c in columns if kinds[c] >= 10]
    if not wide:
        raise ValueError("no column takes ten values")
    fit = data.agg(*[f(c).alias(f"{n}_{c}") for c in wide for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    log: Column = F.lit(0.0)
    for c in wide:
        z = (F.col(c) - fit[f"m_{c}"]) / fit[f"s_{c}"]
        log = log - z * z / 2 - math.log(fit[f"s_{c}"] * math.sqrt(2 * math.pi))
    return points.select(F.col(id_column).alias("id"), F.exp(log).alias("density"))


def density_membership(train: DataFrame, hold: DataFrame, synthetic: DataFrame, columns: list[str], mode: str = "kde", disjoint: bool = False, id_column: str = "id", share: float = 0.7) -> DataFrame:
    """One row: accuracy and auc of the attack that takes rows for members where the synthetic kernel density is large against a reference density.

    Members are the train rows, others the first `share` of the hold-out by id. The reference is the kernel density of
    the last `share` of the hold-out, which overlaps the first (with disjoint only of the rest), or, in mode "prior",
    that of independent normals fitted on train and hold-out. The score is p / (reference + 1e-10); rows above its
    median are guessed to be members. Ids differ over all three tables.
    """
    from tabveil.operators.privacy import rank_auc

    n = hold.count()
    size = int(n * share)
    rows = materialise(numbered(hold.select(F.col(id_column).alias("id"), *columns), [F.col("id")], "_i"), "hold-out")
    asked = train.select(F.col(id_column).alias("id"), *columns, F.lit(True).alias("member")).unionByName(rows.where(F.col("_i") < size).select("id", *columns, F.lit(False).alias("member")))
    if mode == "kde":
        reference = kernel_density(asked, rows.where(F.col("_i") >= (size if disjoint else n - size)), columns)
    elif mode == "prior":
        reference = normal_density(asked, train.select(*columns).unionByName(rows.select(*columns)), columns)
    else:
        raise ValueError("mode is kde or prior")
    x = asked.select("id", "member").join(kernel_density(asked, synthetic, columns, id_column="id"), "id").join(reference.withColumnRenamed("density", "_r"), "id")
    x = materialise(x.select("member", (F.col("density") / (F.col("_r") + 1e-10)).alias("score")), "scores")
    cut = quantiles(x, [], "score", [0.5]).select(F.col("q")[0].alias("cut"))
    accuracy = x.crossJoin(F.broadcast(cut)).agg(F.avg(((F.col("score") > F.col("cut")) == F.col("member")).cast("double")).alias("accuracy"))  # one row
    return accuracy.crossJoin(rank_auc(x, F.col("member"), "score"))  # one row each
