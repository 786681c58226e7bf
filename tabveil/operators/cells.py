"""Cells of a kd tree over the numeric rows of a table: what lets joins on distance leave out most pairs.

The tree is fitted on a bounded sample; every row then goes to the leaf that it falls into, and each leaf keeps how many
rows it has and the exact box around them. A point with a radius reaches the leaves whose box isn't farther away; the
tree is walked from the top with all points of a batch at once. Points and rows of a leaf meet in blocks of bounded
size, so a leaf may hold any number of either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.session import materialise, ship

#: The tree is fitted on at most so many rows, those of the smallest hashes of their ids, and has at most so many leaves.
SAMPLE, LEAVES = 1 << 17, 1 << 15
#: Rows that a leaf is meant to have, and rows in a block of either side.
LEAF_ROWS, LEFT_BLOCK, RIGHT_BLOCK = 512, 4096, 16384


def numeric_rows(df: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """id and x, an array of the columns as doubles; no row with NULL or NaN in one."""
    parts = [F.col(c).cast("double") for c in columns]
    known = [p.isNotNull() & ~F.isnan(p) for p in parts]
    whole = known[0]
    for k in known[1:]:
        whole = whole & k
    return df.where(whole).select(F.col(id_column).cast("long").alias("id"), F.array(*parts).alias("x"))


def points_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of arrays of one length as rows."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, width)), *[c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in chunks]])


class Cells:
    """A complete binary tree in heap order: node n has the children 2n and 2n + 1, the leaves come last."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaves, width = leaves, sample.shape[1]
        self.dim, self.cut = np.zeros(leaves, np.int64), np.full(leaves, math.inf)
        spread = sample.std(axis=0) if len(sample) else np.zeros(width)
        scale = np.where(spread > 0, spread, 1)
        parts = {1: sample / scale}
        for node in range(1, leaves):
            x = parts.pop(node, np.zeros((0, width)))
            if len(x) > 1:
                d = int((x.max(axis=0) - x.min(axis=0)).argmax())
                v = x[:, d]
                cut = float(np.median(v))
                cut = cut if cut < v.max() else float(np.max(v[v < cut], initial=-math.inf))  # both sides get rows, if values differ
                if math.isfinite(cut):
                    self.dim[node], self.cut[node] = d, cut * scale[d]
                    parts[2 * node], parts[2 * node + 1] = x[v <= cut], x[v > cut]
                    continue
            parts[2 * node] = x
        self.count, self.mean = np.zeros(leaves, np.int64), np.zeros((leaves, width))
        self.low, self.high = np.full((2 * leaves, width), math.inf), np.full((2 * leaves, width), -math.inf)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        node = np.ones(len(x), np.int64)
        rows = np.arange(len(x))
        while len(node) and node[0] < self.leaves:
            node = 2 * node + (x[rows, self.dim[node]] > self.cut[node])
        return node - self.leaves

    def fill(self, leaf: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, mean: np.ndarray) -> None:
        """What the leaves hold; the boxes of the nodes above follow."""
        self.mean[leaf] = mean
        self.count[leaf], self.low[self.leaves + leaf], self.high[self.leaves + leaf] = count, low, high
        for n in range(self.leaves - 1, 0, -1):
            self.low[n], self.high[n] = np.minimum(self.low[2 * n], self.low[2 * n + 1]), np.maximum(self.high[2 * n], self.high[2 * n + 1])

    def near(self, node: np.ndarray | int, x: np.ndarray, weight: np.ndarray | float, metric: str) -> np.ndarray:
        """Distances that no row below the node is closer than."""
        away = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0) * weight
        return away.sum(axis=-1) if metric == "l1" else np.sqrt((away * away).sum(axis=-1))

    def far(self, node: np.ndarray | int, x: np.ndarray, weight: np.ndarray | float, metric: str) -> np.ndarray:
        """Distances that no row below the node is farther than."""
        away = np.maximum(np.abs(self.low[node] - x), np.abs(self.high[node] - x)) * weight
        return away.sum(axis=-1) if metric == "l1" else np.sqrt((away * away).sum(axis=-1))

    def reach(self, x: np.ndarray, radius: np.ndarray, weight: np.ndarray | float = 1.0, metric: str = "l2") -> tuple[np.ndarray, np.ndarray]:
        """row, leaf: the leaves with rows whose boxes are within each row's radius; weight is a row for each row of x, or one number."""
        rows, leaves, todo = [], [], [(1, np.arange(len(x)))]
        limit = radius * (1 + 1e-9)
        while todo:
            node, at = todo.pop()
            w = weight[at] if isinstance(weight, np.ndarray) else weight
            at = at[self.near(node, x[at], w, metric) <= limit[at]]
            if len(at) and node >= self.leaves:
                if self.count[node - self.leaves]:
                    rows.append(at)
                    leaves.append(np.full(len(at), node - self.leaves))
            elif len(at):
                todo += [(2 * node, at), (2 * node + 1, at)]
        row, leaf = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, leaves))
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]

    def inside(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sure, row, leaf: how many rows lie within the radius of each row of x by the boxes alone, and the leaves whose boxes leave it open."""
        total = np.concatenate([np.zeros(self.leaves, np.int64), self.count])
        for n in range(self.leaves - 1, 0, -1):
            total[n] = total[2 * n] + total[2 * n + 1]
        sure, rows, leaves, todo = np.zeros(len(x), np.int64), [], [], [(1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not total[node]:
                continue
            at = at[self.near(node, x[at], 1.0, "l2") <= radius * (1 + 1e-9)]
            whole = self.far(node, x[at], 1.0, "l2") <= radius * (1 - 1e-9)
            sure[at[whole]] += total[node]
            at = at[~whole]
            if len(at) and node >= self.leaves:
                rows.append(at)
                leaves.append(np.full(len(at), node - self.leaves))
            elif len(at):
                todo += [(2 * node, at), (2 * node + 1, at)]
        row, leaf = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, leaves))
        order = np.lexsort((leaf, row))
        return sure, row[order], leaf[order]

    def enough(self, x: np.ndarray, n: int, weight: np.ndarray | float = 1.0, metric: str = "l2") -> np.ndarray:
        """Radii within which n rows lie for sure, infinite where there are fewer."""
        nodes = self.leaves + np.flatnonzero(self.count)
        out = np.full(len(x), math.inf)
        for i in range(len(x)):
            d = self.far(nodes, x[i], weight[i] if isinstance(weight, np.ndarray) else weight, metric)
            order = np.argsort(d)
            total = np.cumsum(self.count[nodes - self.leaves][order])
            at = int(np.searchsorted(total, n))
            out[i] = d[order[at]] if at < len(total) else math.inf
        return out


def fit_cells(rows: DataFrame, width: int, leaf_rows: int | None = None) -> tuple[Cells, DataFrame]:
    """The tree of a table (id, x of that length, and others), and the table with cell, written down."""
    ship(rows.sparkSession)
    rows = materialise(rows, "points")
    picked = rows.select("x", F.xxhash64("id", F.lit(5)).alias("h")).orderBy("h", "x").limit(SAMPLE).toArrow()
    n = picked.num_rows if picked.num_rows < SAMPLE else rows.count()
    leaves = 1 << max(0, math.ceil(math.log2(max(1, min(n / (leaf_rows or LEAF_ROWS), LEAVES, picked.num_rows)))))
    cells = Cells(points_of(picked.column("x"), width), min(leaves, LEAVES))
    placed = materialise(in_cells(rows, lambda x: cells.home(x), width), "cells")
    about = {"low": F.min, "high": F.max, "mean": F.avg}
    parts = [F.struct(*[f(F.get("x", i)) for i in range(width)]).alias(n) for n, f in about.items()]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *parts).collect()  # at most LEAVES rows
    if boxes:
        cells.fill(np.array([b.cell for b in boxes]), np.array([b.n for b in boxes]), *[np.array([list(b[n]) for b in boxes]) for n in about])
    return cells, placed


def in_cells(rows: DataFrame, home: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """rows with cell."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = home(points_of(b.column(b.schema.get_field_index("x")), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    return rows.mapInArrow(run, f"{fields}, cell int")


def meet(queries: DataFrame, placed: DataFrame, cells: Cells, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: str, key: list[Column], first_block: bool = False) -> tuple[DataFrame | None, dict[int, int]]:
    """What solve makes of the queries (a written table, with cell) and the placed rows of each cell, block by block; and the queries of each cell. No queries, None.

    key tells queries apart and deals them into blocks. With first_block queries meet one block of their cell only.
    """
    spark = queries.sparkSession
    there = {r.cell: r["count"] for r in queries.groupBy("cell").count().collect()}  # at most LEAVES rows
    blocks = [(c, math.ceil(n / LEFT_BLOCK), max(1, math.ceil(int(cells.count[c]) / RIGHT_BLOCK))) for c, n in there.items()]
    if not blocks:
        return None, there
    sizes = F.broadcast(spark.createDataFrame(blocks, "cell int, lefts int, rights int"))  # at most LEAVES rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = queries.join(sizes, "cell").withColumns({"_l": F.pmod(F.xxhash64(*key, F.lit(1)), F.col("lefts")).cast("int"), "_r": F.lit(0) if first_block else every("rights")})
    b = placed.join(sizes, "cell").withColumn("_r", F.pmod(F.xxhash64("id", F.lit(2)), F.col("rights")).cast("int"))
    b = (b.where("_r = 0") if first_block else b).withColumn("_l", every("lefts"))
    drop = lambda d: d.drop("lefts", "rights")
    return drop(a).groupBy("cell", "_l", "_r").cogroup(drop(b).groupBy("cell", "_l", "_r")).applyInArrow(solve, schema), there
