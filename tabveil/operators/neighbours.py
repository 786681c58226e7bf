"""Nearest neighbours between two numeric tables: the k smallest distances from each left row to the right table.

Right rows lie in the cells of a kd tree. A left row first meets the rows of the cell that it falls into; the k-th
distance there is a radius, and where it reaches into other cells the row meets these in a second round. Neither side
is held whole, and only the k best rows of each meeting are kept. In many dimensions radii reach into nearly all cells,
and the work is that of all pairs.

Left rows may be asked in several replicates at once: each with a sample of the right table, and with weights and a
place of the row of its own. Right rows carry the list of samples that they are in, so that all replicates share one
tree, one copy of the right table and the two rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.operators import cells as C
from tabveil.session import materialise

FOUND = "id long, rep int, others array<long>, distances array<double>, more array<int>"


def smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k smallest entries of each row, equal ones from the left; d is used up."""
    k = min(k, d.shape[1])
    at, value, rows = np.zeros((len(d), k), np.int64), np.zeros((len(d), k)), np.arange(len(d))
    if k <= 12:
        for n in range(k):
            at[:, n] = d.argmin(axis=1)
            value[:, n] = d[rows, at[:, n]]
            d[rows, at[:, n]] = math.inf
        return at, value
    last = np.partition(d, k - 1, axis=1)[:, k - 1]
    for i in rows:
        near = np.flatnonzero(d[i] <= last[i])
        at[i] = near[np.argsort(d[i][near], kind="stable")][:k]
    return at, np.take_along_axis(d, at, axis=1)


def distances(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None, metric: str) -> np.ndarray:
    d = np.zeros((len(x), len(y)))
    for n in range(x.shape[1]):
        step = np.abs(x[:, n, None] - y[:, n])
        if weight is not None:
            step *= weight[n]
        d += step * step if metric == "l2" else step
    return np.sqrt(d) if metric == "l2" else d


def searcher(cells: C.Cells, width: int, k: int, metric: str, exclude_self: bool, weights: np.ndarray | None, first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What left rows find in a block of a cell; in the first round also which cells they have to look into yet."""
    block = C.RIGHT_BLOCK

    def solve(p: pa.Table, q: pa.Table) -> pa.Table:
        ids, rep, x = p.column("id").to_numpy(), p.column("rep").to_numpy(), C.points_of(p.column("x"), width)
        q = q.sort_by("id")
        qi, y = q.column("id").to_numpy(), C.points_of(q.column("x"), width)
        member = None
        if weights is not None:
            lists = q.column("reps").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            member = np.zeros((len(qi), len(weights)), bool)
            member[np.repeat(np.arange(len(qi)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()] = True
        others, found = [[] for _ in ids], [[] for _ in ids]
        radius = np.full(len(ids), math.inf)
        for r in np.unique(rep):
            mine = np.flatnonzero(rep == r)
            there = np.arange(len(qi)) if member is None else np.flatnonzero(member[:, r])
            for lo in range(0, len(mine) if len(there) else 0, 128):
                part = mine[lo : lo + 128]
                d = distances(x[part], y[there], None if weights is None else weights[r], metric)
                if exclude_self:
                    d[ids[part, None] == qi[there]] = math.inf
                at, value = smallest(d, k)
                for i, a, v in zip(part, qi[there][at].tolist(), value.tolist(), strict=True):
                    n = sum(map(math.isfinite, v))
                    others[i], found[i] = a[:n], v[:n]
                    if n == k:
                        radius[i] = v[-1]
        more = [[] for _ in ids]
        if first:
            w = 1.0 if weights is None else weights[rep]
            short = np.flatnonzero(np.isinf(radius))
            if weights is None and len(short):
                radius[short] = cells.enough(x[short], k + 1, 1.0, metric)
            cell = p.column("cell")[0].as_py() if p.num_rows else -1
            whole = cell >= 0 and cells.count[cell] <= block
            for i, leaf in zip(*(v.tolist() for v in cells.reach(x, radius, w, metric)), strict=True):
                if leaf != cell or not whole:
                    more[i].append(leaf)
            if not whole:  # another round meets all of the cell
                others, found = ([[] if cell in m else o for o, m in zip(v, more, strict=True)] for v in (others, found))
        return pa.table([pa.array(ids, pa.int64()), pa.array(rep, pa.int32()), pa.array(others, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.float64())), pa.array(more, pa.list_(pa.int32()))], names=["id", "rep", "others", "distances", "more"])

    return solve


def search(left: DataFrame, right: DataFrame, width: int, k: int, metric: str = "l2", exclude_self: bool = False, weights: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """id, rep, rank, other, distance; and how many pairs of rows were compared.

    left has id, x and rep, right id and x, and with weights (a row a replicate) also reps, the replicates that it
    takes part in. Both have arrays x of that width. Ids differ within each table.
    """
    # of equal rows, those of the k + 1 smallest ids can be neighbours
    place = F.dense_rank().over(Window.partitionBy("x").orderBy("id"))
    cells, placed = C.fit_cells(right.withColumn("_n", place).where(F.col("_n") <= k + 1).drop("_n") if weights is None else right, width, None if weights is None else 4 * C.LEAF_ROWS)
    key = [F.col("id"), F.col("rep")]
    queries = materialise(C.in_cells(left, lambda x: cells.home(x), width), "queries")
    run = lambda first: searcher(cells, width, k, metric, exclude_self, weights, first)
    one, asked = C.meet(queries, placed, cells, run(True), FOUND, key, first_block=True)
    compared = sum(n * min(int(cells.count[c]), C.RIGHT_BLOCK) for c, n in asked.items())
    found = queries.select("id", "rep", F.array().cast("array<long>").alias("others"), F.array().cast("array<double>").alias("distances"))
    if one is not None:
        found = one = materialise(one, "neighbours")
        further = queries.drop("cell").join(one.where(F.size("more") > 0).select("id", "rep", "more"), ["id", "rep"]).withColumn("cell", F.explode("more")).drop("more")
        two, asked = C.meet(materialise(further, "further"), placed, cells, run(False), FOUND, key)
        if two is not None:
            compared += sum(n * int(cells.count[c]) for c, n in asked.items())
            found = one.unionByName(two)
    found = found.select("id", "rep", F.explode(F.arrays_zip("others", "distances")).alias("x")).select("id", "rep", F.col("x.others").alias("other"), F.col("x.distances").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("id", "rep").orderBy("distance", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rep", "rank", "other", "distance"), compared


def k_nearest(left: DataFrame, right: DataFrame, columns: list[str], k: int = 1, metric: str = "l2", id_column: str = "id", exclude_self: bool = False) -> DataFrame:
    """id, rank, other, distance: for each left row the k nearest right rows; ties go to the smaller id.

    Both have id_column (numbers, distinct in each table) and the columns. Rows with NULL or NaN in one take
    no part. With exclude_self a row of the same id isn't a neighbour. Fewer than k rows give fewer neighbours.
    """
    a = C.numeric_rows(left, columns, id_column).withColumn("rep", F.lit(0))
    return search(a, C.numeric_rows(right, columns, id_column), len(columns), k, metric, exclude_self)[0].drop("rep")


def pairs_compared(left: DataFrame, right: DataFrame, columns: list[str], k: int = 1, metric: str = "l2", id_column: str = "id", exclude_self: bool = False) -> DataFrame:
    """One row: compared, the pairs of rows whose distance k_nearest computes, and pairs, how many there are."""
    a, b = (C.numeric_rows(d, columns, id_column) for d in (left, right))
    compared = search(a.withColumn("rep", F.lit(0)), b, len(columns), k, metric, exclude_self)[1]
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((a, "n"), (b, "m"))]
    return counts[0].crossJoin(counts[1]).select(F.lit(compared).cast("long").alias("compared"), (F.col("n") * F.col("m")).alias("pairs"))  # one row each
