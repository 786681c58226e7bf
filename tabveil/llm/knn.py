"""Exact top-k search by inner product as a Voronoi join.

Pivots cut the space into cells. Every vector goes to its nearest pivot's cell; a summary of each cell (how many
vectors lie within each step of distance, and the largest norm) bounds from below the k-th best score that a query
can count on, and so does the k-th best score among the sample that the pivots come from. Queries are grouped by cell; a
group keeps the lowest of these bounds and its queries' largest distance from the pivot. A data vector x is copied to a
group only where p.x + u*|x| (p the group's pivot, u that distance) reaches the group's bound: else no query of the
group can want it. Groups that would get nearly all vectors, as in many dimensions, are put together, so that these are
copied once for all. Groups are solved in blocks of bounded size, and the blocks' winners are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.session import materialise, ship

#: Pivots are fitted on at most this many vectors, those of the smallest hashes of their ids.
PIVOT_SAMPLE = 4096
PIVOTS = 64
RINGS = 32
QUERY_BLOCK, DATA_BLOCK = 1024, 16384
#: The cell of the queries that all vectors meet.
ALL = -1


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and vec, each component x as floor(scale * x); no vector that is null or holds null, NaN or infinity."""
    x = F.col(vector_column).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(whole).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vec"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, short ones filled with 0."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    n = np.diff(at)
    rows = np.repeat(np.arange(len(column)), n)
    out[rows, np.arange(at[0], at[-1]) - np.repeat(at[:-1], n)] = flat[at[0] : at[-1]]
    return out


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the farthest from those before it."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and a distance from it that isn't too small."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)
    cell = d.argmin(axis=1)
    return cell, np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(axis=1), 0)) * (1 + 1e-9) + 1e-6


def meet_all(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which groups of n queries are better put together and met by all vectors once than each by its share of the vectors."""
    blocks = np.ceil(n / QUERY_BLOCK)
    order = np.argsort(-share, kind="stable")
    together = np.ceil(np.concatenate([[0], np.cumsum(n[order])]) / QUERY_BLOCK)
    apart = np.concatenate([np.cumsum((share * blocks)[order][::-1])[::-1], [0]])
    out = np.zeros(len(n), dtype=bool)
    out[order[: int((together + apart).argmin())]] = True
    return out


def top_k(spark_vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (vec_id, vec) with is_query the k rows of other ids with the largest integer inner product.

    Ties go to the smaller vec_id; a query with fewer than k candidates returns all. A vector with fewer components
    than another counts as filled up with 0. Rows that repeat a vec_id are candidates of their own with equal rank
    order, and repeated query rows count once. An empty table gives no rows. Other columns are not read.
    """
    spark = spark_vectors.sparkSession
    ship(spark)
    vectors = spark_vectors.select("vec_id", "vec")
    picked = vectors.select("vec_id", "vec", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).toArrow()
    first, sample_ids = picked.column("vec").combine_chunks(), picked.column("vec_id").to_numpy()
    width = int(vectors.agg(F.max(F.size("vec"))).first()[0] or 0)
    if isinstance(first, pa.ChunkedArray):
        first = first.chunk(0) if first.num_chunks else pa.array([], pa.list_(pa.int64()))
    schema = "query_id long, rank int, vec_id long, score long"
    if not len(first) or not width:
        width = max(width, 1)
    sample = matrix(first, width) if len(first) else np.zeros((0, width))
    pivots = pick_pivots(sample, n_pivots) if len(first) else np.zeros((1, width))
    sent = spark.sparkContext.broadcast((sample_ids, sample))  # at most PIVOT_SAMPLE rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width)
            cell, d = cells(x, pivots)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array(d), pa.array(np.sqrt((x * x).sum(axis=1))), b.column(1)], ["vec_id", "cell", "d", "norm", "vec"])

    assigned = materialise(vectors.mapInArrow(assign, "vec_id long, cell int, d double, norm double, vec array<long>"), "knn-cells")
    queries = materialise(assigned.where(is_query).dropDuplicates(["vec_id"]), "knn-queries")
    copies = int(assigned.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)  # rows that a query's own id may have
    far = float(assigned.agg(F.max("d")).first()[0] or 1.0)
    rings = assigned.groupBy("cell", F.ceil(F.col("d") * (RINGS / far)).cast("int").alias("ring")).count().collect()  # at most pivots x (RINGS + 2) rows
    ring_cell = np.array([r.cell for r in rings], dtype=np.int64)
    ring_far = np.array([r.ring * far / RINGS for r in rings]) * (1 + 1e-9) + 1e-6
    ring_n = np.array([r["count"] for r in rings], dtype=np.int64)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(3), width)
            low = np.full(len(q), -math.inf)
            if len(ring_n):
                least = (q @ pivots.T)[:, ring_cell] - np.sqrt((q * q).sum(axis=1))[:, None] * ring_far
                order = np.argsort(-least, axis=1)
                seen = np.cumsum(ring_n[order], axis=1)  # k others and, it may be, the query itself
                enough = seen >= k + copies
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), -1)
                low = np.where(at >= 0, np.take_along_axis(least, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0], -math.inf)
            ids, vectors_there = sent.value
            for lo in range(0, len(q) if len(ids) >= k else 0, 512):  # the k-th best score of the sample's rows is a bound too
                score = q[lo : lo + 512] @ vectors_there.T
                score[b.column(0).to_numpy()[lo : lo + 512, None] == ids] = -math.inf
                low[lo : lo + 512] = np.maximum(low[lo : lo + 512], np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(low)], ["cell", "d", "low"])

    q_in = queries.select("vec_id", "cell", "d", "vec")
    groups = q_in.mapInArrow(bounds, "cell int, d double, low double").groupBy("cell").agg(F.min("low").alias("low"), F.max("d").alias("u"), F.count("*").alias("n")).collect()  # at most one row a pivot
    if not groups:
        return spark.createDataFrame([], schema)
    g_cell = np.array([g.cell for g in groups])
    g_low = np.array([g.low for g in groups])
    g_u = np.array([g.u for g in groups])
    n_rows = int(ring_n.sum())
    # what the summaries leave of the sample tells which groups are worth copies of their own
    reached = sample @ pivots[g_cell].T + np.sqrt((sample * sample).sum(axis=1))[:, None] * g_u >= g_low
    g_n, g_all = np.array([g.n for g in groups]), meet_all(reached.mean(axis=0), np.array([g.n for g in groups]))
    q_blocks = {g.cell: max(1, math.ceil(g.n / QUERY_BLOCK)) for g, a in zip(groups, g_all, strict=True) if not a}
    if g_all.any():
        q_blocks[ALL] = max(1, math.ceil(int(g_n[g_all].sum()) / QUERY_BLOCK))
        cell = F.when(F.col("cell").isin([int(c) for c in g_cell[g_all]]), F.lit(ALL)).otherwise(F.col("cell"))
        q_in = q_in.withColumn("cell", cell)
    g_cell, g_low, g_u = (x[~g_all] for x in (g_cell, g_low, g_u))
    meets_all = bool(g_all.any())
    d_blocks = max(1, math.ceil(n_rows / DATA_BLOCK))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, vec = matrix(b.column(1), width), b.column(1)
            if meets_all:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), ALL), pa.int32()), b.column(0), vec], ["cell", "vec_id", "vec"])
            reach = x @ pivots[g_cell].T + np.sqrt((x * x).sum(axis=1))[:, None] * g_u
            for g in range(len(g_cell)):
                rows = np.flatnonzero(reach[:, g] * (1 + 1e-9) + 1e-3 + np.abs(reach[:, g]) * 1e-9 >= g_low[g])
                if len(rows):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g_cell[g]), pa.int32()), b.column(0).take(take), vec.take(take)], ["cell", "vec_id", "vec"])

    salt = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(d_blocks)).cast("int")
    block = F.create_map(*[F.lit(x) for kv in q_blocks.items() for x in kv])[F.col("cell")]
    data = assigned.select("vec_id", "vec").mapInArrow(replicate, "cell int, vec_id long, vec array<long>").select("cell", F.explode(F.sequence(F.lit(0), block - 1)).alias("qb"), salt.alias("db"), "vec_id", "vec")
    asked = q_in.select("cell", F.pmod(F.xxhash64("vec_id", F.lit(3)), block).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1))).alias("db"), "vec_id", "vec")

    def solve(q: pa.Table, d: pa.Table) -> pa.Table:
        out = [[], [], []]
        if q.num_rows and d.num_rows:
            d = d.sort_by("vec_id")
            qi, di = q.column("vec_id").to_numpy(), d.column("vec_id").to_numpy()
            qx, dx = (matrix(t.column("vec").combine_chunks() if t.column("vec").num_chunks != 1 else t.column("vec").chunk(0), width) for t in (q, d))
            if np.abs(qx).max(initial=0) * np.abs(dx).max(initial=0) * width < 2**53:
                score = (qx @ dx.T).astype(np.int64)
            else:
                score = qx.astype(np.int64) @ dx.astype(np.int64).T
            for i in range(len(qi)):
                others = np.flatnonzero(di != qi[i])
                s = score[i][others]
                if len(s) > k:
                    kth = np.partition(s, len(s) - k)[len(s) - k]
                    keep = np.flatnonzero(s >= kth)
                else:
                    keep = np.arange(len(s))
                keep = keep[np.argsort(-s[keep], kind="stable")][:k]  # equal scores stay in the order of vec_id
                out[0] += [int(qi[i])] * len(keep)
                out[1] += di[others[keep]].tolist()
                out[2] += s[keep].tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("cell", "qb", "db").cogroup(data.groupBy("cell", "qb", "db")).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
