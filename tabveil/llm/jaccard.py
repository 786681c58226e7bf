"""N-gram Jaccard join: components of documents whose sets of word shingles are alike, by a grouped prefix join.

A document's set is put in one order for all documents, rare shingles first (by a sketch of fixed size, ties by hash),
and its prefix is long enough that two similar sets share one of its shingles. Equal sets are one variant, variants
with equal prefix and size are one group, and only groups meet on shingles. A pair meets only where the shingle comes so
early in both sets that it can be the first they share, and stays only where its prefixes hold enough common shingles; it
is then expanded to variants, verified on their whole sets.

A group of near copies never meets in all its pairs: first each meets a few centres of its shingles, those with the
fewest rare shingles of their own, and only what these links have not yet put in one component meets in pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.bytesarrays import M1, chunks, mix, word_hashes, words
from tabveil.llm.components import connected_components
from tabveil.session import discard, materialise, ship

WORDS = 5
SLOT_BITS, PARTS = 22, 64
WANTED_BITS = 24
#: Groups on one shingle, those with the fewest rarer ones, that all others on it meet first.
CENTRES = 4
#: Pairs of groups left after the centres, of one in so many variants, that go to their whole sets without a look at prefixes.
FEW = 16
APART = "NOT (c_lo_x = c_hi_x AND c_lo_y = c_hi_y AND c_lo_x = c_lo_y)"


def shingles(data: np.ndarray, at: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, text by text and in order, and each text's first."""
    begin, end, first = words(data, at)
    h = word_hashes(data, begin, end)
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(n)), n)
    start = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(start[-1]) - start[owner] + first[owner]
    out = np.full(len(place), 7, np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    short = np.minimum(n_words, width)[owner]
    for i in range(width):
        inside = i < short
        out = np.where(inside, (out ^ (padded[place + i] + np.uint64(i + 1))) * M1, out)
        out ^= out >> np.uint64(31)
    out = mix(out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(len(n) + 1))


def sketch(docs: DataFrame, text_column: str) -> np.ndarray:
    """Classes of frequency of the shingles' slots: 2**SLOT_BITS small numbers, twice the binary logarithm of the counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for b in batches:
            for _, _, data, at in chunks(b, text_column):
                h, _ = shingles(data, at)
                slot, n = np.unique((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), return_counts=True)
                total[slot] += n.astype(np.uint32)
        parts = [(n, p) for n, p in enumerate(total.reshape(PARTS, -1)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in parts], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for _, p in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint32)
                total[part] = total[part] + x if part in total else x.astype(np.uint64)
        for part, x in total.items():
            level = np.round(2 * np.log2(x + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "levels"])

    rows = docs.select(text_column).mapInArrow(count, "part int, counts binary").repartition(PARTS, "part").mapInArrow(add, "part int, levels binary")
    rows = materialise(rows, "levels", tidy=True)  # PARTS rows, 4 MB together
    out = np.zeros((PARTS, (1 << SLOT_BITS) // PARTS), np.uint8)
    for r in rows.collect():
        out[r.part] = np.frombuffer(r.levels, np.uint8)
    discard(rows)
    return out.ravel()


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    """So many first shingles of a set of n hold one of any set with similarity 0.8."""
    return n - (4 * n + 4) // 5 + (n > 0)


def document_sets(docs: DataFrame, id_column: str, text_column: str, levels: Broadcast) -> DataFrame:
    """rid, doc_id, n, s1, s2 (names of the set), p1, p2 (of its prefix), prefix: one row for each row of docs. levels: see sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index(id_column))
            for lo, hi, data, at in chunks(b, text_column):
                h, first = shingles(data, at)
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, levels.value[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], owner))
                size = prefix_sizes(n)
                p_at = np.concatenate([[0], np.cumsum(size)])
                p_owner = np.repeat(np.arange(len(n)), size)
                prefix = h[order][np.arange(p_at[-1]) - p_at[p_owner] + first[p_owner]]
                s1, s2, p1, p2 = (total(x, y).view(np.int64) for x, y in ((h, first), (mix(h ^ M1), first), (prefix, p_at), (mix(prefix ^ M1), p_at)))
                lists = pa.ListArray.from_arrays(pa.array(p_at.astype(np.int32)), pa.array(prefix.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), *map(pa.array, (s1, s2, p1, p2)), lists], ["doc_id", "n", "s1", "s2", "p1", "p2", "prefix"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>")
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()), "sets", tidy=True)


def total(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values, as numbers modulo 2**64, from each first to the next."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + M1), out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def sizes_fit(n: Column, m: Column) -> Column:
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m))


def in_first(at: Column, n: Column, m: Column) -> Column:
    """Whether the place (from 0) of a shingle in a set of n can be that of the first one that it shares with a set of m, if they reach 0.8."""
    return 9 * (n - at) >= 4 * (n + m)


def slot_bitmap(df: DataFrame, name: Column) -> Broadcast:
    """Packed bits, of fixed size, of the highest bits of all names."""
    slots = df.select(F.shiftrightunsigned(name, 64 - WANTED_BITS).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()  # at most 2**WANTED_BITS
    bitmap = np.zeros(1 << WANTED_BITS, dtype=bool)
    bitmap[slots] = True
    return df.sparkSession.sparkContext.broadcast(np.packbits(bitmap))


def known_upto(x: np.ndarray, y: np.ndarray, level_x: np.ndarray, level_y: np.ndarray) -> tuple[int, int]:
    """How many shingles of the prefixes x and y lie up to the end of that which ends first; levels: those of their shingles."""
    if (level_x[-1], x[-1]) > (level_y[-1], y[-1]):
        return known_upto(y, x, level_y, level_x)[::-1]
    lo, hi = np.searchsorted(level_y, level_x[-1], "left"), np.searchsorted(level_y, level_x[-1], "right")
    return len(x), int(lo + np.searchsorted(y[lo:hi], x[-1], "right"))


def possible(pairs: DataFrame, full: DataFrame, levels: Broadcast) -> DataFrame:
    """Those of pairs (a, b) of groups that may reach 0.8 by their prefixes.

    Up to the end of the prefix that ends first all common shingles are known; after it, no more than the smaller rest is common.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid"))
    sent = slot_bitmap(wanted, F.xxhash64("rid"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).view(bool)
        for b in batches:
            yield b.filter(pa.array(known[b.column(3).to_numpy()]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i, (n, x, m, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5), strict=True)):
                x, y = (p.values.to_numpy().view(np.uint64) for p in (x, y))
                i_x, i_y = known_upto(x, y, *(levels.value[(p >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] for p in (x, y)))
                common = len(np.intersect1d(x, y, assume_unique=True)) + min(n - i_x, m - i_y)
                if 100 * common >= 80 * (n + m - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], ["a", "b"])

    slot = F.shiftrightunsigned(F.xxhash64("rid"), 64 - WANTED_BITS).cast("int")
    found = full.select("rid", "n", "prefix", slot.alias("slot")).mapInArrow(some, "rid long, n long, prefix array<long>, slot int")
    found = materialise(found.join(wanted, "rid", "left_semi").drop("slot"), "wanted-prefixes", tidy=True)
    x, y = (found.select(F.col("rid").alias(v), F.col("n").alias(f"n_{v}"), F.col("prefix").alias(f"p_{v}")) for v in "ab")
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "n_a", "p_a", "n_b", "p_b")
    out = materialise(both.mapInArrow(compare, "a long, b long"), "possible-groups", tidy=True)
    discard(found)
    return out


def wanted_sets(docs: DataFrame, text_column: str, pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """vid, shingles of the variants in pairs (a, b). Only sets that a bitmap of fixed size lets through are moved."""
    names = variants.select("vid", "s1", "s2")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct().join(names, "vid")
    sent = slot_bitmap(wanted, F.col("s1"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = np.unpackbits(sent.value).view(bool), set()
        for b in batches:
            for _, _, data, at in chunks(b, text_column):
                h, first = shingles(data, at)
                s1, s2 = total(h, first), total(mix(h ^ M1), first)
                rows = [i for i in np.flatnonzero(known[(s1 >> np.uint64(64 - WANTED_BITS)).astype(np.int64)] & (np.diff(first) > 0)).tolist() if (int(s1[i]), int(s2[i])) not in done]
                if len(done) < 100_000:  # equal sets of one task need not all be moved; the join drops the rest
                    done.update((int(s1[i]), int(s2[i])) for i in rows)
                if rows:
                    cut = [h[first[i] : first[i + 1]] for i in rows]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)), pa.array(np.concatenate(cut).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(s1[rows].view(np.int64)), pa.array(s2[rows].view(np.int64)), lists], ["s1", "s2", "shingles"])

    sets = docs.select(text_column).mapInArrow(some, "s1 long, s2 long, shingles array<long>")
    once = sets.groupBy("s1", "s2").agg(F.first("shingles").alias("shingles"))
    return materialise(once.join(wanted, ["s1", "s2"]).select("vid", "shingles"), "wanted-sets", tidy=True)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets reach 0.8. The sets are deleted."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for n, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    good.append(n)
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], ["a", "b"])

    x = pairs.select("a", "b").join(sets.select(F.col("vid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("vid").alias("b"), F.col("shingles").alias("y")), "b")
    out = materialise(x.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links", tidy=True)
    discard(sets)
    return out


def may_meet(x: tuple[Column, Column], y: tuple[Column, Column]) -> Column:
    """Whether sets may be similar in which a shingle they share has these sizes and places (n, at)."""
    return sizes_fit(x[0], y[0]) & in_first(x[1], x[0], y[0]) & in_first(y[1], y[0], x[0])


def met_tokens(tokens: DataFrame) -> DataFrame:
    """token, gid, n, at of tokens that several groups have, rank among these, centres: the gids of those among the first CENTRES, of lower rank, that it may meet."""
    on = Window.partitionBy("token")
    tokens = tokens.withColumn("rank", F.row_number().over(on.orderBy(F.col("at") / F.col("n"), F.xxhash64("gid")))).withColumn("size", F.count("*").over(on)).where("size > 1")
    first = F.collect_list(F.when(F.col("rank") <= CENTRES, F.struct("rank", "gid", "n", "at"))).over(on)
    mine = F.filter("first", lambda c: (c["rank"] < F.col("rank")) & may_meet((F.col("n"), F.col("at")), (c["n"], c["at"])))
    return tokens.withColumn("first", first).select("token", "gid", "n", "at", "rank", F.transform(mine, lambda c: c["gid"]).alias("centres"))


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, n_shingles, component_id: the smallest id reachable over links of similarity 0.8, one row for each row of docs.

    Words are what white space (0x20, 0x09 to 0x0D) separates, A-Z lower-cased; a set holds the distinct shingles of
    five words, or the whole sequence if there are fewer. Null texts and texts without words have empty sets, link with
    nothing and are components of their own. Rows that repeat an id are documents of their own that share it. A null id
    is larger than all others. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    levels = spark.sparkContext.broadcast(sketch(docs, text_column))
    sets = document_sets(docs, id_column, text_column, levels)
    full = sets.where("n > 0")
    variants = full.groupBy("n", "s1", "s2").agg(F.min("rid").alias("vid"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    variants = materialise(variants, "variants", tidy=True)
    groups = materialise(variants.groupBy("n", "p1", "p2").agg(F.min("vid").alias("gid"), F.count("*").alias("k")), "groups", tidy=True)
    member = materialise(variants.join(groups, ["n", "p1", "p2"]).select("vid", "gid", "n", "s1", "s2", "k"), "members", tidy=True)

    tokens = full.select(F.col("rid").alias("gid"), "n", "prefix").join(groups.select("gid"), "gid").select("gid", "n", F.posexplode("prefix").alias("at", "token"))
    tokens = materialise(met_tokens(tokens), "met-tokens", tidy=True)
    discard(variants, groups)
    stars = materialise(tokens.select(F.col("gid").alias("a"), F.explode("centres").alias("b")).distinct(), "star-groups", tidy=True)
    met, stars = stars, possible(stars, full, levels)
    discard(met)
    within = member.where("k > 1 AND vid != gid").select(F.col("gid").alias("a"), F.col("vid").alias("b"))
    pairs = stars.join(member.select(F.col("gid").alias("b"), "vid"), "b").select("a", F.col("vid").alias("b"))
    pairs = materialise(pairs.unionByName(within), "star-pairs", tidy=True)
    links = verified(pairs, wanted_sets(docs, text_column, pairs, member))
    component = materialise(connected_components(links), "components", tidy=True)
    at = member.join(component.withColumnRenamed("node", "vid"), "vid", "left").select("vid", "gid", "n", "k", F.coalesce("component", "vid").alias("c"))
    at = materialise(at, "members-at", tidy=True)
    spread = at.groupBy("gid").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))
    rest = tokens.where(F.col("rank") > CENTRES).drop("centres").join(spread, "gid")
    mixed = rest.groupBy("token").agg(F.min("c_lo").alias("lo"), F.max("c_hi").alias("hi")).where("lo < hi").select("token")
    rest = materialise(rest.join(mixed, "token"), "mixed-tokens", tidy=True)
    x, y = (rest.select("token", *[F.col(c).alias(f"{c}_{side}") for c in rest.columns if c != "token"]) for side in "xy")
    meet = x.join(y, "token").where("rank_x > rank_y").where(may_meet(*((F.col(f"n_{side}"), F.col(f"at_{side}")) for side in "xy"))).where(APART).select("gid_x", "gid_y")
    # of the groups that met a centre only one member did, and those of one prefix met only one another's first
    x, y = (spread.select(*[F.col(c).alias(f"{c}_{side}") for c in spread.columns]) for side in "xy")
    meet = meet.unionByName(stars.select(F.col("a").alias("gid_x"), F.col("b").alias("gid_y")).join(x, "gid_x").join(y, "gid_y").where(APART).select("gid_x", "gid_y"))
    meet = meet.unionByName(spread.where("c_lo < c_hi").select(F.col("gid").alias("gid_x"), F.col("gid").alias("gid_y")))
    met = materialise(meet.select(F.col("gid_x").alias("a"), F.col("gid_y").alias("b")).distinct(), "met-groups", tidy=True)
    many = met.count() * FEW > member.count()  # few are cheaper to verify than to look up; whole sets of more don't follow the input
    meet = (possible(met, full, levels) if many else met).select(F.col("a").alias("gid_x"), F.col("b").alias("gid_y"))
    a, b = (at.select(F.col("gid").alias(f"gid_{side}"), F.col("vid").alias(v), F.col("c").alias(f"c_{side}")) for side, v in (("x", "a"), ("y", "b")))
    unordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = unordered(meet.join(a, "gid_x").join(b, "gid_y").where("c_x != c_y")).distinct().join(unordered(pairs), ["a", "b"], "left_anti")
    left = materialise(left, "rest-pairs", tidy=True)
    discard(tokens, stars, rest, at, met)
    if not left.isEmpty():
        more = verified(left, wanted_sets(docs, text_column, left, member))
        if not more.isEmpty():
            component = materialise(connected_components(links.unionByName(more)), "components-2", tidy=True)

    of = member.join(component.withColumnRenamed("node", "vid"), "vid", "left").select("n", "s1", "s2", F.coalesce("component", "vid").alias("c"))
    rows = full.select("doc_id", "n", "s1", "s2").join(of, ["n", "s1", "s2"])
    least = rows.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "c").select("doc_id", "n", "component_id").unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")
