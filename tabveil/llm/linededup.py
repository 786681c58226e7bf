"""Line dedup: a suffix array over sequences of line ids by prefix doubling.

After k rounds of doubling, positions with equal names are the interval of the suffix array whose common prefix is
at least 2**k lines; a round joins the names of two neighbouring stretches and keeps only intervals of two or more.
A run of lines is worth deleting from `min_chars` characters on. The shortest such run from each line forwards and
the shortest backwards to it are named by the two overlapping stretches of 2**k lines that cover them; together the
repeated ones among them cover exactly the maximal repeated runs of that size. All but the first copy are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.session import materialise

MIN_CHARS = 150
KEY = ["_id", "_h"]


def named(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit names of the parts."""
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def repeated(df: DataFrame, names: list[str], at: str) -> DataFrame:
    """Rows of df whose names recur, with later: whether an equal one begins at an earlier (_id, _h, at)."""
    place = F.struct(*KEY, at)
    first = df.groupBy(*names).agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    return df.join(first, names).withColumn("later", place > F.col("_first")).drop("_first")


def deleted_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """_id (a struct, so that null ids join), _h, gone (array<int>): the numbers of the lines to delete from each text that loses any."""
    text = F.col(text_column)
    # hashed before the lines are taken apart, so that this happens once a text and not once a line
    texts = docs.select(F.struct(F.col(id_column).alias("id")).alias("_id"), F.xxhash64(text).alias("_h"), F.split(text, "\n", -1).alias("_lines"))
    lines = texts.select(*KEY, F.posexplode("_lines").alias("pos", "line"))
    a, b = named(F.col("line"))
    lines = materialise(lines.select(*KEY, "pos", a.alias("a"), b.alias("b"), F.length("line").cast("long").alias("chars")).dropDuplicates([*KEY, "pos"]), "lines")
    again = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b", F.lit(0).alias("fresh"))
    flagged = lines.join(again, ["a", "b"], "left").select(*KEY, "pos", "a", "b", "chars", F.coalesce("fresh", F.lit(1)).alias("fresh"))

    doc = Window.partitionBy(*KEY)
    so_far = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = flagged.withColumns({"upto": F.sum("chars").over(so_far), "fresh_upto": F.sum("fresh").over(so_far)})
    x = x.withColumns({"total": F.max("upto").over(doc), "last": F.max("pos").over(doc), "before": F.col("upto") - F.col("chars")})
    forward = F.coalesce(F.min("pos").over(doc.orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -min_chars)) - 1, F.when(F.col("total") - F.col("before") >= min_chars, F.col("last")))
    backward = F.coalesce(F.max("pos").over(doc.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_chars)) + 1, F.when(F.col("upto") >= min_chars, F.lit(0)))
    x = x.withColumns({"to": forward, "from": backward}).where("fresh = 0")
    # a stretch with a line that occurs once can't recur
    kept = materialise(x.select(*KEY, "pos", "a", "b", F.col("fresh_upto").alias("none_before"), F.col("to").cast("int").alias("to"), F.col("from").cast("int").alias("from")), "lines-again")
    ends = kept.select(*KEY, F.col("pos").alias("_p"), F.col("none_before").alias("_n"))
    ahead = kept.where("to IS NOT NULL").select(*KEY, F.col("pos").alias("s"), F.col("to").alias("e"), "none_before").join(ends.withColumnRenamed("_p", "e"), [*KEY, "e"]).where("none_before = _n").select(*KEY, "s", "e")
    back = kept.where("from IS NOT NULL AND from < pos").select(*KEY, F.col("from").alias("s"), F.col("pos").alias("e"), "none_before").join(ends.withColumnRenamed("_p", "s"), [*KEY, "s"]).where("none_before = _n").select(*KEY, "s", "e")
    runs = materialise(ahead.unionByName(back).dropDuplicates(), "line-runs")
    longest = runs.agg(F.max(F.col("e") - F.col("s") + 1)).first()[0] or 0

    names, k, found = kept.select(*KEY, "pos", "a", "b"), 0, []
    while longest >= 1 << k:
        span = 1 << k
        here = runs.where(F.col("e") - F.col("s") + 1 >= span).where(F.col("e") - F.col("s") + 1 < 2 * span)
        if k == 0:
            run = here.join(names.withColumnRenamed("pos", "s"), [*KEY, "s"])
        else:
            head = names.select(*KEY, F.col("pos").alias("s"), F.col("a").alias("a1"), F.col("b").alias("b1"))
            tail = names.select(*KEY, (F.col("pos") + span - 1).alias("e"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            run = here.join(head, [*KEY, "s"]).join(tail, [*KEY, "e"])
            a, b = named(F.col("e") - F.col("s"), "a1", "b1", "a2", "b2")
            run = run.select(*KEY, "s", "e", a.alias("a"), b.alias("b"))
        found.append(repeated(run, ["a", "b"], "s").where("later").select(*KEY, "s", "e"))
        if longest >= 2 * span:  # the next round: name(2**(k+1)) from name(2**k) here and 2**k lines on
            following = F.max(F.struct("a", "b")).over(doc.orderBy("pos").rangeBetween(span, span))
            a, b = named(F.col("a"), F.col("b"), F.col("next.a"), F.col("next.b"))
            pairs = names.withColumn("next", following).where("next IS NOT NULL").select(*KEY, "pos", a.alias("a"), b.alias("b"))
            names = materialise(repeated(pairs, ["a", "b"], "pos").select(*KEY, "pos", "a", "b"), f"line-names-{k + 1}")
        k += 1
    if not found:
        found.append(runs.limit(0))
    later = found[0]
    for more in found[1:]:
        later = later.unionByName(more)
    return later.select(*KEY, F.explode(F.sequence("s", "e")).alias("pos")).groupBy(*KEY).agg(F.collect_set("pos").alias("gone"))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, report: bool = False) -> DataFrame:
    """docs with later copies of repeated line runs deleted from the text; with report also n_lines and n_removed.

    Lines end at \\n. A run counts from min_chars characters (line ends not counted) on; runs may overlap and may recur
    within one text. Earlier means a smaller id (null first), then a smaller hash of the text, then a smaller line
    number. Rows that repeat both id and text are one text and get the same result. A null text stays null and has no
    lines; a text whose lines all go becomes empty. Columns other than the two stay as they are.
    """
    gone = deleted_lines(docs, id_column, text_column, min_chars).select(F.col("_id").alias("_gone_id"), F.col("_h").alias("_gone_h"), F.col("gone").alias("_gone"))
    x = docs.withColumn("_text_h", F.xxhash64(text_column)).join(gone, (F.struct(F.col(id_column).alias("id")) == F.col("_gone_id")) & (F.col("_text_h") == F.col("_gone_h")), "left")
    cut = F.split(F.col(text_column), "\n", -1)
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    # inside a function of its own, so that the text is split once
    kept = F.transform(F.array(cut), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))[0]
    text = F.when(F.col("_gone").isNull(), F.col(text_column)).otherwise(kept)
    columns = [text.alias(c) if c == text_column else F.col(c) for c in docs.columns]
    if report:
        columns += [F.when(F.col(text_column).isNotNull(), F.size(cut)).otherwise(0).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed")]
    return x.select(*columns)
