"""Hard-negative mining by threshold joins of vectors over an inverted index without what suffix norms cover.

Anchors carry windows of scores: one of the best rows of their own label, then for each of these positives one of the
best rows of other labels between two shares of the positive's score. All rows with a score of at least an anchor's
threshold (its lowest window's end) are found by a join of blocks. In each meeting of a block of anchors with one of
rows, components come in an order of falling size, and a row's are indexed only up to where the norm of its rest,
times the largest such norm of an anchor, can't reach the lowest threshold any more; rows that aren't indexed at all
aren't even copied to the block. Scores are accumulated along the index; a row falls out when partial scores and the
norms of what remains stay below every threshold, and only pairs that stay get what was omitted added. Full windows
raise thresholds within a block; a window starts from the k-th best score that a sample puts into it, or from its
middle, and is lowered to its end in another round while it isn't full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.knn import matrix
from tabveil.session import materialise, ship

#: Starting thresholds come from at most so many rows, those of the smallest hashes of their ids, and so many numbers.
SAMPLE, SAMPLE_CELLS = 4096, 1 << 19
#: Rows in a block at most, and numbers in it.
ANCHOR_BLOCK, DATA_BLOCK, BLOCK_CELLS = 4096, 16384, 1 << 21
#: Rows of a block that are scored together, and components between two prunings.
STEP, SLICE = 1024, 8
#: Where a window that the sample doesn't fill starts: shares of the way from its top to its end, one a round.
ROUNDS = (0.5, 1.0)
EPS = 1e-9
#: Scores as doubles are exact below this.
EXACT = 2.0**53


def labelled_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label and vec, each component x as floor(scale * x); no row with a null label, or a vector that is null or holds null, NaN or infinity."""
    x = F.col(vector_column).cast("array<double>")
    whole = F.col(label_column).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(whole).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vec"))


def rows_of(t: pa.Table, width: int) -> np.ndarray:
    """The vectors of a table."""
    chunks = t.column("vec").chunks
    return np.concatenate([np.zeros((0, width)), *[matrix(c, width) for c in chunks]])


def grid(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, NaN for nulls and behind the end."""
    rows = column.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0)), np.nan)
    for i, r in enumerate(rows):
        out[i, : len(r)] = [np.nan if v is None else v for v in r]
    return out


def tails(x: np.ndarray) -> np.ndarray:
    """Norms of what follows each SLICE of components; column 0 is of all."""
    whole = np.add.reduceat(x * x, np.arange(0, x.shape[1], SLICE), axis=1)
    rest = np.concatenate([np.cumsum(whole[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
    return np.sqrt(rest) * (1 + EPS)


def reachable(x: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) whose product is at least the q row's threshold, and the products.

    Both have components in index order. Rows of x are sorted by how many slices of theirs are indexed, so a slice's
    postings are the first rows.
    """
    xt, qt = tails(x), tails(q)
    slices = xt.shape[1] - 1
    low = least.min(initial=math.inf)
    covered = xt * qt.max(axis=0) + 1e-3 < low  # the rest from here on can't reach any threshold
    indexed = np.where(covered.any(axis=1), covered.argmax(axis=1), slices)
    rows = np.argsort(-indexed, kind="stable")
    rows = rows[indexed[rows] > 0]
    partial = np.zeros((len(q), len(rows)))
    for n in range(slices):
        post = int((indexed[rows] > n).sum())
        if not post:
            break
        part = slice(n * SLICE, (n + 1) * SLICE)
        partial[:, :post] += q[:, part] @ x[rows[:post], part].T
        done = np.minimum(indexed[rows], n + 1)
        alive = (partial + qt[:, done] * xt[rows, done] + 1e-3 >= least[:, None]).any(axis=0)
        if alive.sum() < 0.8 * len(rows):
            rows, partial = rows[alive], partial[:, alive]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    end = indexed[rows]
    qi, ri = np.nonzero(partial + qt[:, end] * xt[rows, end] + 1e-3 >= least[:, None])
    score = partial[qi, ri]
    for n in np.unique(end[ri]):  # what the index omits, for these pairs only
        some = np.flatnonzero(end[ri] == n)
        for lo in range(0, len(some) if n < slices else 0, 1 << 16):
            s = some[lo : lo + (1 << 16)]
            score[s] += (q[qi[s], n * SLICE :] * x[rows[ri[s]], n * SLICE :]).sum(axis=1)
    good = score >= least[qi]
    return qi[good], rows[ri[good]], score[good]


class Windows:
    """The best k rows so far in each window of each anchor."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        """low, high: a row an anchor, a column a window; NaN where an anchor has fewer."""
        self.low, self.high, self.k = np.where(np.isnan(low), math.inf, low), high, k
        self.best = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0)]  # anchor, window, id, score

    def least(self) -> np.ndarray:
        return self.low.min(axis=1, initial=math.inf)

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        found = [[self.best[i]] for i in range(4)]
        for w in range(self.low.shape[1]):
            inside = (score >= self.low[anchor, w]) & (score <= self.high[anchor, w])
            for into, x in zip(found, (anchor[inside], np.full(int(inside.sum()), w), ids[inside], score[inside]), strict=True):
                into.append(x)
        anchor, window, ids, score = (np.concatenate(x) for x in found)
        order = np.lexsort((ids, -score, window, anchor))
        anchor, window, ids, score = anchor[order], window[order], ids[order], score[order]
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
        place = np.arange(len(anchor)) - np.maximum.accumulate(np.where(first, np.arange(len(anchor)), 0)) if len(anchor) else np.zeros(0, np.int64)
        keep = place < self.k
        self.best = [c[keep] for c in (anchor, window, ids, score)]
        full = place == self.k - 1
        self.low[anchor[full], window[full]] = score[full]


def meeting(width: int, order: np.ndarray, k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What one block of anchors finds in one block of rows: anchor_id, window, vec_id, score, the best k for each window."""

    def meet(a: pa.Table, d: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64) for _ in range(4)]
        if a.num_rows and d.num_rows:
            q, x = rows_of(a, width)[:, order], rows_of(d, width)[:, order]
            if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width >= EXACT:
                raise ValueError("integer components are too large for exact scores")
            ai, al = a.column("vec_id").to_numpy(), a.column("label").to_numpy()
            di, dl = d.column("vec_id").to_numpy(), d.column("label").to_numpy()
            windows = Windows(grid(a.column("low")), grid(a.column("high")), k)
            by_norm = np.lexsort((di, -(x * x).sum(axis=1)))
            for label in np.unique(al) if same else [None]:
                mine = np.flatnonzero(al == label) if same else np.arange(len(al))
                there = by_norm[dl[by_norm] == label] if same else by_norm
                for lo in range(0, len(there), STEP):
                    rows = there[lo : lo + STEP]
                    i, j, score = reachable(x[rows], q[mine], windows.least()[mine])
                    i, j = mine[i], rows[j]
                    other = (ai[i] != di[j]) & (same | (al[i] != dl[j]))
                    if other.any():
                        windows.add(i[other], di[j[other]], score[other])
            anchor, window, ids, score = windows.best
            out = [ai[anchor], window, ids, score.astype(np.int64)]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "window", "vec_id", "score"])

    return meet


def threshold_join(anchors: DataFrame, data: DataFrame, width: int, order: np.ndarray, k: int, same: bool) -> DataFrame:
    """anchor_id, window, rank, vec_id, score: for each window (low and high of an anchor, arrays of whole scores) the k best rows of data inside, ties to smaller ids.

    anchors has distinct vec_id, label, vec, low, high; data vec_id, label, vec. With same only rows of the anchor's
    label count, else only those of others; never those of its id. Both must be written tables.
    """
    fit = lambda most: max(1, min(most, BLOCK_CELLS // width))
    ab, db = max(1, math.ceil(anchors.count() / fit(ANCHOR_BLOCK))), max(1, math.ceil(data.count() / fit(DATA_BLOCK)))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    a = anchors.withColumn("ab", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(ab)).cast("int"))
    reach = a.groupBy("ab").agg(F.max(norm).alias("far"), F.min(F.array_min("low")).alias("least"))
    x = data.select("vec_id", "label", "vec", norm.alias("norm"), F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(db)).cast("int").alias("db"), F.explode(F.sequence(F.lit(0), F.lit(ab - 1))).alias("ab"))
    x = x.join(reach, "ab").where(F.col("norm") * F.col("far") * (1 + EPS) + 1e-3 >= F.col("least")).select("ab", "db", "vec_id", "label", "vec")
    a = a.select("ab", F.explode(F.sequence(F.lit(0), F.lit(db - 1))).alias("db"), "vec_id", "label", "vec", "low", "high")
    found = a.groupBy("ab", "db").cogroup(x.groupBy("ab", "db")).applyInArrow(meeting(width, order, k, same), "anchor_id long, window long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def sampled(sample: pa.Table, width: int, k: int, same: bool) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The k-th best score that the sample puts into each window of anchors, NaN where it has fewer."""
    x, ids, labels = rows_of(sample, width), sample.column("vec_id").to_numpy(), sample.column("label").to_numpy()

    def kth(q: np.ndarray, qi: np.ndarray, ql: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.full(low.shape, np.nan)
        for lo in range(0, len(q) if len(ids) >= k else 0, 256):
            part = slice(lo, lo + 256)
            score = q[part] @ x.T
            score[(qi[part, None] == ids) | ((ql[part, None] == labels) != same)] = np.nan
            for w in range(low.shape[1]):
                inside = np.where((score >= low[part, w, None]) & (score <= high[part, w, None]), score, -math.inf)
                best = np.partition(inside, len(ids) - k, axis=1)[:, len(ids) - k]
                out[part, w] = np.where(np.isfinite(best), best, np.nan)
        return out

    return kth


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank of rows (vec_id, label, vec).

    Each anchor's positives are its best other rows of its label by integer inner product; each positive's negatives
    the best rows of other labels whose score is from low to high percent of the positive's. Ties go to the smaller
    vec_id, and a window with fewer rows returns all. A vector with fewer components than another counts as filled up
    with 0. An anchor's id with several rows takes the row of the smallest label and vector; rows that repeat a vec_id
    are candidates of their own. Components whose scores could pass 2^53 are refused. An empty table gives no rows.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    data = materialise(vectors.select("vec_id", "label", "vec"), "vectors")
    width = int(data.agg(F.max(F.size("vec"))).first()[0] or 1) or 1
    sample = data.withColumn("h", F.xxhash64("vec_id", F.lit(11))).orderBy("h", "vec_id", "vec").limit(max(1, min(SAMPLE, SAMPLE_CELLS // width))).drop("h").toArrow()
    order = np.argsort(-(rows_of(sample, width) ** 2).sum(axis=0), kind="stable")
    sent = spark.sparkContext.broadcast(sample)  # at most SAMPLE_CELLS numbers
    anchors = data.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec")

    def start(df: DataFrame, k: int, same: bool) -> DataFrame:
        """df (vec_id, label, vec, low, high) with filled, the sample's k-th best score of each window."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kth = sampled(sent.value, width, k, same)
            for b in batches:
                got = kth(matrix(b.column(2), width), b.column(0).to_numpy(), b.column(1).to_numpy(), grid(b.column(3)), grid(b.column(4)))
                filled = [[None if np.isnan(v) else v for v in r[:n]] for r, n in zip(got, b.column(3).value_lengths().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(filled, pa.list_(pa.float64()))], [*b.schema.names, "filled"])

        return df.select("vec_id", "label", "vec", "low", "high").mapInArrow(run, "vec_id long, label long, vec array<long>, low array<double>, high array<double>, filled array<double>")

    whole = anchors.withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    begun = start(whole, positives, True).withColumn("low", F.transform("filled", lambda v: F.coalesce(v, F.lit(float("-inf"))))).drop("filled")
    best = materialise(threshold_join(materialise(begun, "anchors"), data, width, order, positives, True), "positives")
    best = best.select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    down = lambda share: F.expr(f"({share}L * positive_score - pmod({share}L * positive_score, 100L)) div 100L")  # noqa: E731  that share of the score, rounded down
    edges = best.withColumns({"low": (-down(-low)).cast("double"), "high": down(high).cast("double")}).where("low <= high")
    edges = edges.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "low", "high"))).alias("w"))  # one entry a positive
    asked = anchors.join(edges, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vec", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.col("w.positive_rank").alias("ranks"))
    asked = materialise(start(asked, negatives, False).join(asked.select("vec_id", "ranks"), "vec_id"), "windows")
    out, open_ = None, asked.withColumn("sure", F.transform("filled", lambda v: v.isNotNull()))
    for n, share in enumerate(ROUNDS):
        end = F.transform(F.arrays_zip("low", "high", "filled"), lambda w: F.coalesce(w["filled"], w["high"] - F.floor((w["high"] - w["low"]) * share)))
        turn = materialise(open_.withColumns({"end": end}).select("vec_id", "label", "vec", F.col("end").alias("low"), "high", F.col("low").alias("last"), "ranks", "sure"), "anchors-asked")
        found = materialise(threshold_join(turn.select("vec_id", "label", "vec", "low", "high"), data, width, order, negatives, False), "negatives")
        count = found.groupBy("anchor_id", "window").agg(F.count("*").alias("n")).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "n"))).alias("got"))  # one entry a window
        state = turn.join(count, F.col("vec_id") == F.col("anchor_id"), "left").withColumn("full", F.transform("sure", lambda s, i: s | (F.coalesce(F.element_at("got", i.cast("long")), F.lit(0)) >= negatives) | F.lit(n == len(ROUNDS) - 1)))
        state = materialise(state.select("vec_id", "label", "vec", "low", "high", "last", "ranks", "sure", "full"), "state")
        done = found.join(state.select("vec_id", "ranks", "full").withColumnRenamed("vec_id", "_a"), F.col("anchor_id") == F.col("_a")).where(F.get("full", F.col("window").cast("int")))
        done = done.select("anchor_id", F.get("ranks", F.col("window").cast("int")).alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = done if out is None else out.unionByName(done)
        keep = F.filter(F.arrays_zip(F.col("last").alias("low"), "high", "ranks", "full"), lambda w: ~w["full"])
        open_ = state.withColumn("w", keep).where(F.size("w") > 0).select("vec_id", "label", "vec", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.col("w.ranks").alias("ranks"), F.transform("w", lambda w: F.lit(None).cast("double")).alias("filled"), F.transform("w", lambda w: F.lit(False)).alias("sure"))
        if open_.isEmpty():
            break
    return out.join(best, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "positive_rank")
