"""Text quality by Bradley-Terry ranking.

Each text becomes a few shares of its bytes, words and lines. A preference pair is a labelled good text against a
labelled bad one; the model is the weight vector that makes logistic loss on the differences of their features small,
so a text's score is its strength in such comparisons. A quantile of the training scores is the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm.bytesarrays import chunks, word_hashes, words
from tabveil.operators.codes import quantiles
from tabveil.session import materialise, ship

#: Width of a cell of strength: within it losses are cubic up to 1e-9.
CELL = 1 / 64
#: Once a limit of the fit, which has none now; a test sets it.
FIT_ROWS = None
ACCEPT = 0.7
FEATURES = ("upper", "digit", "mark", "sign", "bar", "shout", "high", "word_upper", "word_sign", "word_long", "repeat", "echo", "word_len", "line_short", "line_same", "distinct")


def byte_class(members: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(members.encode())] = 1
    return out


_UPPER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + byte_class("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = 1
_DIGIT = byte_class("0123456789")
_MARK = byte_class(".,;:'\"-()?")
_SIGN = byte_class("#$%&*@^~_+=<>{}[]\\/`")
_BAR, _SHOUT = byte_class("|"), byte_class("!")
_HIGH = np.zeros(256)
_HIGH[128:] = 1


def per_text(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of value from each begin in at to the next."""
    sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return sums[at[1:]] - sums[at[:-1]]


def again(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each row's hash came before in the same text."""
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(hashes))
    same[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return same


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; all 0 for an empty one."""
    n, n_bytes = len(at) - 1, np.maximum(np.diff(at), 1)
    begin, end, first = words(data, at)
    n_words = np.maximum(np.diff(first), 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    hashes = word_hashes(data, begin, end)
    sums = {k: np.concatenate([[0.0], np.cumsum(c[data])]) for k, c in (("upper", _UPPER), ("letter", _LETTER), ("sign", _SIGN + _BAR + _SHOUT))}
    inside = {k: s[end] - s[begin] for k, s in sums.items()}
    length = (end - begin).astype(np.float64)
    echo = np.zeros(len(begin))
    echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    newline = np.zeros(256, dtype=bool)
    newline[10] = True
    l_begin, l_end, l_first = words(data, at, newline)
    l_owner = np.repeat(np.arange(n), np.diff(l_first))
    n_lines = np.maximum(np.diff(l_first), 1)
    l_again = again(word_hashes(data, l_begin, l_end), l_owner) * (l_end - l_begin)
    w_again = again(hashes, owner)
    columns = [
        *(per_text(c[data], at) / n_bytes for c in (_UPPER, _DIGIT, _MARK, _SIGN, _BAR, _SHOUT, _HIGH)),
        per_text((inside["upper"] > 1) & (inside["upper"] == inside["letter"]), first) / n_words,
        per_text((inside["sign"] > 0), first) / n_words,
        per_text(length > 24, first) / n_words,
        per_text(w_again, first) / n_words,
        per_text(echo, first) / n_words,
        per_text(np.minimum(length, 40), first) / n_words / 10,
        per_text((l_end - l_begin) < 20, l_first) / n_lines,
        per_text(l_again, l_first) / n_bytes,
        np.log1p(n_words - per_text(w_again, first)) / np.log1p(n_words),
    ]
    out = np.sqrt(np.maximum(np.stack(columns, axis=1), 0))  # small shares count
    out[np.diff(at) == 0] = 0
    return out


def text_features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *kept: str) -> DataFrame:
    """id_column and features array<double> of every row's whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in chunks(b, text_column):
                x = features(data, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in ids), lists], [*ids, "features"])

    ids = [id_column, *kept]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    return docs.select(*ids, text_column).mapInArrow(run, f"{fields}, features array<double>")


def derivatives(t: np.ndarray) -> list[np.ndarray]:
    """The logistic function of -t and its first three derivatives."""
    q = 1 / (1 + np.exp(np.clip(t, -700, 700)))
    v = q * (1 - q)
    return [q, -v, v * (1 - 2 * q), -v * (1 - 6 * v)]


def losses(own: np.ndarray, other: np.ndarray, moments: np.ndarray, side: int) -> np.ndarray:
    """Summed over the texts of the other label, the chance that the wrong one wins, at the middles of cells of strength, and its first three derivatives.

    The others lie in cells too, with the sums of 1, d, d**2 and d**3 of their distances d from the middle; side is 1
    where own texts are the good ones, else -1.
    """
    out = np.zeros((4, len(own)))
    for lo in range(0, len(own), 512):
        f = derivatives(side * (own[lo : lo + 512, None] - other))
        for m in range(4):
            for k in range(4 - m):
                out[m, lo : lo + 512] += side**m * (-side) ** k / math.factorial(k) * (f[m + k] @ moments[k])
    return out


def strengths(w: np.ndarray) -> Column:
    return F.aggregate(F.zip_with("features", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def newton_step(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss summed over all pairs of a good and a bad row (features, quality), in two scans.

    The first counts texts by cells of strength; the second lets every row meet the cells of the other label.
    """
    width = len(w)
    x = rows.select("features", "quality", strengths(w).alias("s")).withColumn("cell", F.floor(F.col("s") / CELL))
    d = F.col("s") - (F.col("cell") + 0.5) * CELL
    got = x.groupBy("quality", "cell").agg(F.count("*").cast("double").alias("m0"), *[F.sum(F.pow(d, F.lit(k))).alias(f"m{k}") for k in (1, 2, 3)], *[F.sum(F.get("features", i)).alias(f"x{i}") for i in range(width)]).orderBy("quality", "cell").collect()  # cells of strength, which the ridge bounds
    told, at = {}, {}
    for y in (0, 1):
        mine = [r for r in got if r.quality == y]
        at[y] = np.array([r.cell for r in mine])
        told[y] = (at[y] + 0.5) * CELL, np.array([[r[f"m{k}"] for r in mine] for k in range(4)]), np.array([[r[f"x{i}"] for i in range(width)] for r in mine])
    table = {y: losses(told[y][0], *told[1 - y][:2], 2 * y - 1) for y in (0, 1)}
    cross = np.zeros((width, width))
    for lo in range(0, len(at[1]), 512):
        cross -= told[1][2][lo : lo + 512].T @ derivatives(told[1][0][lo : lo + 512, None] - told[0][0])[1] @ told[0][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, hessian = np.zeros(width), np.zeros((width, width))
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            quality, strength, cell = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            for y in (0, 1):
                use = quality == y
                place = np.searchsorted(at[y], cell[use])
                z, (f0, f1, f2, f3) = strength[use] - told[y][0][place], table[y][:, place]
                gradient += (1 - 2 * y) * (f0 + z * (f1 + z * (f2 / 2 + z * f3 / 6))) @ v[use]
                curve = (1 - 2 * y) * (f1 + z * (f2 + z * f3 / 2))
                hessian += (v[use] * curve[:, None]).T @ v[use]
        values = np.concatenate([gradient, hessian.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "v"])

    sums = np.array([r.v for r in x.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])  # a number for each of them
    hessian = sums[width:].reshape(width, width)
    return sums[:width], hessian - cross - cross.T


def newton(step, width: int, pairs: float, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights at which the mean loss with the ridge is least, to nine digits, so that the order of sums doesn't show."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, hessian = step(w)
        move = np.linalg.solve(hessian / pairs + ridge * np.eye(width), gradient / pairs + ridge * w)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return np.round(w, 9)


def fit_all(rows: DataFrame, width: int = len(FEATURES)) -> tuple[np.ndarray, float]:
    """Bradley-Terry weights over all pairs of good and bad rows (features, quality), and the threshold; zeros if there are no pairs."""
    n = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}  # at most two
    good, bad = n.get(1, 0), n.get(0, 0)
    if not good or not bad:
        return np.zeros(width), 0.0
    w = newton(lambda v: newton_step(rows, v), width, float(good) * bad)
    # between the ranks around the share of bad texts
    place = (min(max(bad, 1), good + bad - 1) - 0.5) / (good + bad - 1)
    return w, float(quantiles(rows.select(strengths(w).alias("s")), [], "s", [place]).select(F.col("q")[0]).first()[0])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """The same from arrays, pair by pair: for few rows."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0
    d = (x[good][:, None] - x[bad][None]).reshape(-1, x.shape[1])

    def step(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(d @ w, -700, 700)))
        return d.T @ (p - 1), (d * (p * (1 - p))[:, None]).T @ d

    w = newton(step, x.shape[1], float(len(d)), ridge)
    s = np.sort(x @ w)
    cut = min(max(len(bad), 1), len(s) - 1)
    return w, float((s[cut - 1] + s[cut]) / 2)  # the quantile of the share of bad texts


def held_out(id_column: str = "doc_id"):
    """crc32 of the id as text leaves 2 modulo 4: such rows' labels are not for training."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", *kept: str) -> DataFrame:
    """id_column, held_out, score (0 to 1), predicted: one row for each row of docs.

    Labels only of rows that aren't held out are learned from, each id once with its lowest label; null labels and
    ids without a text row are left out. Null and empty texts have no features and get the score of such. Without both
    kinds of labels all scores are 0.7. Repeated rows stay; columns named in kept come along, others are not read. All
    labelled rows and all pairs of them are learned from.
    """
    found = materialise(text_features(docs, id_column, text_column, *kept), "quality-features")
    learn = labels.where(~held_out(id_column) & F.col("quality").isin(0, 1)).groupBy(id_column).agg(F.min("quality").alias("quality"))
    rows = materialise(found.join(learn, id_column).select("features", "quality"), "quality-rows")
    w, cut = fit_all(rows)
    strength = strengths(w)
    score = 1 / (1 + F.exp(-(strength - F.lit(cut) + F.lit(float(np.log(ACCEPT / (1 - ACCEPT)))))))
    return found.select(id_column, *kept, held_out(id_column).alias("held_out"), F.round(score, 12).alias("score")).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
