"""Singling-out attacks: predicates guessed from a synthetic table, and how many pick out exactly one row of others.

A predicate is a conjunction of atoms on columns: at most, at least or equal to a number, equal to a text, or null. Any
number of them is counted in one scan: each batch of rows sorts its columns once, an atom is then a slice of a sorted
column, and only the rows in a predicate's shortest slice are looked at. As a predicate singles out if it meets one row,
a task doesn't look for it any more once it has met two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.operators.codes import quantiles
from tabveil.session import materialise, ship

ATOM = "struct<column:string,op:string,num:double,txt:string>"
#: Predicates in one broadcast; more are counted in further scans.
PREDICATES = 50_000
#: Rows that are sorted at a time.
ROWS_AT_ONCE = 100_000


def typed(df: DataFrame, numbers: list[str], texts: list[str], *others: str) -> DataFrame:
    """The columns as double or text; NaN counts as NULL."""
    return df.select(*others, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in numbers], *[F.col(c).cast("string").alias(c) for c in texts])


def atom(column: str, op: Column, num: Column | None = None, txt: Column | None = None) -> Column:
    return F.struct(F.lit(column).alias("column"), op.alias("op"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if txt is None else txt).cast("string").alias("txt"))


def digest(*parts: Column) -> Column:
    """A hash that puts things into an order that only they decide."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


class Batch:
    """The columns of some rows, sorted."""

    def __init__(self, b: pa.RecordBatch, numbers: list[str], texts: list[str]):
        self.values, self.order, self.sorted, self.null, self.codes = {}, {}, {}, {}, {}
        for c in [*numbers, *texts]:
            x = b.column(b.schema.get_field_index(c))
            known = pc.is_valid(x).to_numpy(zero_copy_only=False)
            if c in texts:
                d = x.dictionary_encode()
                self.codes[c] = {v: i for i, v in enumerate(d.dictionary.to_pylist())}
                v = pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(float)
            else:
                v = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(known)
            order = rows[np.argsort(v[rows], kind="stable")]
            self.values[c], self.order[c], self.sorted[c], self.null[c] = np.where(known, v, np.nan), order, v[order], np.flatnonzero(~known)

    def rows(self, column: str, op: str, num: float | None, txt: str | None) -> np.ndarray:
        """The rows that meet an atom: a slice of the sorted column."""
        if op == "null":
            return self.null[column]
        v = self.codes[column].get(txt, -1) if column in self.codes else num
        lo = 0 if op == "<=" else int(np.searchsorted(self.sorted[column], v, "left"))
        hi = len(self.sorted[column]) if op == ">=" else int(np.searchsorted(self.sorted[column], v, "right"))
        return self.order[column][lo:hi]

    def meets(self, rows: np.ndarray, column: str, op: str, num: float | None, txt: str | None) -> np.ndarray:
        v = self.values[column][rows]
        if op == "null":
            return np.isnan(v)
        at = self.codes[column].get(txt, -1) if column in self.codes else num
        return v <= at if op == "<=" else v >= at if op == ">=" else v == at


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first batch, then batches of some ROWS_AT_ONCE rows, as every predicate takes its time once a batch."""
    held, size = [], 0
    for k, b in enumerate(batches):
        held.append(b)
        size += b.num_rows
        if k == 0 or size >= ROWS_AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def count_matches(df: DataFrame, predicates: DataFrame, numbers: list[str], texts: list[str], most: int | None = None) -> DataFrame:
    """pid, n: how many rows of df meet each predicate (pid, atoms), of those that any row meets; with most, n is right below it and at least most where there are as many.

    The predicates come to the driver and are sent out PREDICATES at a time, so their number is to be bounded by what
    made them. A predicate without atoms is met by no row; NULL meets only the atom null.
    """
    ship(df.sparkSession)
    rows, out = typed(df, numbers, texts), None
    listed = [(r.pid, [tuple(a) for a in r.atoms]) for r in predicates.select("pid", "atoms").collect()]
    for start in range(0, max(1, len(listed)), PREDICATES):
        sent = df.sparkSession.sparkContext.broadcast(listed[start : start + PREDICATES])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted = sent.value
            n = np.zeros(len(wanted), np.int64)
            open_ = [i for i, (_, atoms) in enumerate(wanted) if atoms]
            for b in gathered(batches):
                if most is not None:
                    open_ = [i for i in open_ if n[i] < most]
                if not open_:
                    continue
                used = {a[0] for i in open_ for a in wanted[i][1]}
                x, slices = Batch(b, [c for c in numbers if c in used], [c for c in texts if c in used]), {}
                for i in open_:
                    atoms, found = wanted[i][1], []
                    for a in atoms:
                        if a not in slices:
                            slices[a] = x.rows(*a)
                        found.append(slices[a])
                    least = min(range(len(found)), key=lambda j: len(found[j]))
                    hits = found[least]
                    for j, a in enumerate(atoms):
                        if j != least and len(hits):
                            hits = hits[x.meets(hits, *a)]
                    n[i] += len(hits)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([wanted[i][0] for i in some], pa.string()), pa.array(n[some])], ["pid", "n"])

        one = rows.mapInArrow(run, "pid string, n long")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("pid").agg(F.sum("n").alias("n"))


def univariate(synthetic: DataFrame, numbers: list[str], texts: list[str], attacks: int) -> DataFrame:
    """pid, atoms: predicates on one column that one synthetic row meets: its lone values, its ends, a lone NULL; `attacks` of them in hash order."""
    return lone(value_counts(synthetic, numbers, texts), attacks)


def value_counts(df: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """column, num, txt, n: how many rows have each value of each column."""
    x = typed(df, numbers, texts)
    each = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) if c in numbers else F.lit(None)).cast("double").alias("num"), (F.col(c) if c in texts else F.lit(None)).cast("string").alias("txt")) for c in [*numbers, *texts]])
    return x.select(F.explode(each).alias("v")).groupBy("v.column", "v.num", "v.txt").agg(F.count("*").alias("n"))


def lone(counts: DataFrame, attacks: int) -> DataFrame:
    """What univariate returns, from the table's counts of values."""
    ends = counts.groupBy("column").agg(F.min("num").alias("low"), F.max("num").alias("high"))
    single = counts.where("n = 1").join(F.broadcast(ends), "column")  # a row a column
    known = F.col("num").isNotNull() | F.col("txt").isNotNull()
    ops = F.filter(F.array(F.when(known, "=").otherwise("null"), F.when(F.col("num") == F.col("low"), "<="), F.when(F.col("num") == F.col("high"), ">=")), lambda o: o.isNotNull())
    found = single.select("column", "num", "txt", F.explode(ops).alias("op"))
    pid = digest(F.col("column"), F.col("op"), F.coalesce(F.col("txt"), F.col("num").cast("string"), F.lit("")))
    return found.select(pid.alias("pid"), F.array(F.struct("column", "op", "num", "txt")).alias("atoms")).orderBy("pid").limit(attacks)


def candidates(synthetic: DataFrame, numbers: list[str], texts: list[str], id_column: str, seed: int, tries: int) -> DataFrame:
    """_id and the columns of the `tries` rows that come first in a hashed order."""
    x = synthetic.select(F.col(id_column).alias("_id"), *numbers, *texts)
    return typed(x.orderBy(digest(F.lit(seed), F.col("_id")), "_id").limit(tries), numbers, texts, "_id")


def multivariate(rows: DataFrame, medians: dict[str, float], numbers: list[str], texts: list[str], n_columns: int) -> DataFrame:
    """pid, atoms: for each candidate row a predicate that it meets, on n_columns columns that its hash picks; numbers bound it on the side away from the median."""
    atoms = []
    for c in [*numbers, *texts]:
        value = F.col(c)
        op = F.when(value.isNull(), "null").otherwise(F.when(value > F.lit(medians.get(c)), ">=").otherwise("<=") if c in numbers else F.lit("="))
        atoms.append(F.struct(digest(F.lit(n_columns), F.col("_id"), F.lit(c)).alias("h"), atom(c, op, value if c in numbers else None, value if c in texts else None).alias("a")))
    picked = F.slice(F.array_sort(F.array(*atoms)), 1, n_columns)
    return rows.select(digest(F.lit(n_columns), F.col("_id")).alias("pid"), F.transform(picked, lambda s: s["a"]).alias("atoms"))


def random_guesses(rows: DataFrame, numbers: list[str], texts: list[str], n_columns: int, attacks: int) -> DataFrame:
    """pid, atoms: predicates on hashed columns, values drawn for each column by itself from the candidate rows, numbers bounded on either side."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) if c in numbers else F.lit(None)).cast("double").alias("num"), (F.col(c) if c in texts else F.lit(None)).cast("string").alias("txt"), F.lit(c in numbers).alias("number")) for c in [*numbers, *texts]])
    long = rows.select("_id", F.explode(each).alias("v")).select("_id", "v.*")
    place = F.row_number().over(Window.partitionBy("column").orderBy(digest(F.lit("draw"), F.lit(n_columns), F.col("column"), F.col("_id")), "_id"))  # candidate rows, a bounded number
    long = long.withColumn("i", place).where(F.col("i") <= attacks)
    h = digest(F.lit("pick"), F.lit(n_columns), F.col("i"), F.col("column"))
    null = F.col("num").isNull() & F.col("txt").isNull()
    op = F.when(null, "null").when(~F.col("number"), "=").when(F.substring(h, 1, 1) < "8", "<=").otherwise(">=")
    atoms = F.slice(F.array_sort(F.collect_list(F.struct(digest(F.lit("order"), F.lit(n_columns), F.col("i"), F.col("column")).alias("h"), F.struct("column", op.alias("op"), "num", "txt").alias("a")))), 1, n_columns)
    return long.groupBy("i").agg(atoms.alias("atoms")).select(digest(F.lit("guess"), F.lit(n_columns), F.col("i")).alias("pid"), F.transform("atoms", lambda s: s["a"]).alias("atoms"))


def singling_out_risks(real: DataFrame, control: DataFrame, synthetic: DataFrame, numbers: list[str], texts: list[str], n_columns: tuple[int, ...] = (1, 2, 4, 8), attacks: int = 500, tries: int = 10_000, id_column: str = "id") -> DataFrame:
    """n_columns, attacks, success, control, guesses, baseline: for each size of column set, how many predicates that pick out one synthetic row pick out one real row and one control row, and how many random ones one real row.

    Sets of one column use lone values and ends; larger ones at most `tries` candidate rows, of which the first
    `attacks` predicates that one synthetic row meets stay. The synthetic table is scanned once for its values, once for the candidate rows and once for all
    predicates, the other two once for all that stay. No more columns are used than there are; ids differ. An empty synthetic table gives no attacks.
    """
    spark, width = real.sparkSession, len(numbers) + len(texts)
    sizes = sorted({min(n, width) for n in n_columns})
    values = materialise(value_counts(synthetic, numbers, texts), "values")
    medians = {r["column"]: r.m for r in quantiles(values, ["column"], "num", [0.5], times="n").select("_g.column", F.col("q")[0].alias("m")).collect()} if numbers else {}  # a row a column
    rows = materialise(candidates(synthetic, numbers, texts, id_column, 0, tries), "candidates")
    all_ = None
    for n in sizes:
        one = lone(values, attacks) if n == 1 else multivariate(rows, medians, numbers, texts, n)
        for kind, p in (("attack", one), ("guess", random_guesses(rows, numbers, texts, n, attacks))):
            p = p.select("pid", "atoms", F.lit(n).alias("n_columns"), F.lit(kind).alias("kind"))
            all_ = p if all_ is None else all_.unionByName(p)
    all_ = materialise(all_.dropDuplicates(["pid"]), "predicates")  # at most (2 * attacks + tries) a size
    alone = count_matches(synthetic, all_.where("kind = 'attack'"), numbers, texts, most=2).where("n = 1").select("pid")
    place = F.row_number().over(Window.partitionBy("n_columns").orderBy("pid"))
    kept = all_.join(alone, "pid").withColumn("_i", place).where(F.col("_i") <= attacks).drop("_i")
    kept = materialise(kept.unionByName(all_.where("kind = 'guess'")), "attacks")
    hits = [count_matches(t, kept, numbers, texts, most=2).where("n = 1").select("pid", F.lit(1).alias(name)) for t, name in ((real, "r"), (control, "c"))]
    told = kept.select("pid", "n_columns", "kind").join(hits[0], "pid", "left").join(hits[1], "pid", "left")
    attack = F.col("kind") == "attack"
    counts = told.groupBy("n_columns").agg(
        F.count_if(attack).alias("attacks"), F.count_if(attack & F.col("r").isNotNull()).alias("success"), F.count_if(attack & F.col("c").isNotNull()).alias("control"), F.count_if(~attack).alias("guesses"), F.count_if(~attack & F.col("r").isNotNull()).alias("baseline")
    )
    return spark.createDataFrame([(n,) for n in sizes], "n_columns int").join(counts, "n_columns", "left").na.fill(0)
