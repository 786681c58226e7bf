"""Benchmark decontamination by spaced seeds.

A seed is the hash of a few tokens at the fixed places that a mask keeps; the places between may differ, so a passage
with substituted tokens still shares seeds. Seeds of the documents that a bitmap of the benchmark's seeds (of fixed
size) lets through are gathered into regions of the text, joined with the benchmark's seeds, and each alignment that
a seed suggests is verified token by token around the hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.bytesarrays import chunks, mix, word_hashes, words
from tabveil.session import materialise, ship

#: Fixed masks: 1 keeps a token, 0 ignores it. Whichever fifth of 13 tokens or more differs (or of a whole item of
#: SHORTEST or more), one of them fits; a stretch of 26 or more has a part of 13 to 25 with no larger share of differences.
MASKS = ("11111", "111011", "11001011")
MIN_TOKENS, MIN_SHARE = 13, 0.8
SHORTEST = 10
#: Tokens to each side of its seeds on which an alignment is tried before whole texts are compared.
REACH = 64
BITS = 24
TOKEN_BREAK = np.ones(256, dtype=bool)
TOKEN_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def seeds(tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask its number, the places of seeds that lie within one text, and their hashes."""
    text_end = np.repeat(first[1:], np.diff(first))
    for n, mask in enumerate(MASKS):
        keep = [i for i, c in enumerate(mask) if c == "1"]
        size = len(tokens) - len(mask) + 1
        if size <= 0:
            continue
        h = np.full(size, n + 1, np.uint64)
        for i in keep:
            h = (h ^ tokens[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(np.arange(size) + len(mask) <= text_end[:size])
        yield n, at, mix(h[at])


def token_arrays(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """lo, hi, hashes of the tokens (letters, digits and what isn't ASCII, A-Z lower-cased) and each row's first."""
    for lo, hi, data, at in chunks(batch, column):
        begin, end, first = words(data, at, TOKEN_BREAK)
        yield lo, hi, word_hashes(data, begin, end), first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def benchmark_items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """item_id, tokens: each different text once, under its smallest id."""
    kind = benchmark.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, tokens, first in token_arrays(b, text_column):
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_column)).slice(lo, hi - lo), lists(signed(tokens), first)], ["item_id", "tokens"])

    found = benchmark.select(id_column, text_column).mapInArrow(run, f"item_id {kind}, tokens array<long>")
    return found.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("item_id").alias("item_id")).select("item_id", "tokens")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE) -> DataFrame:
    """id_column, item_id, n_tokens, n_equal: for each document and benchmark item that overlap, the longest overlap.

    An overlap is an alignment of the two texts in which a stretch of at least min_tokens tokens (or the whole item, if
    that is shorter, but at least SHORTEST), of which at least min_share are equal, is found; with the default numbers
    every such stretch holds a seed that both share, with lower ones only those that do are found. Each alignment that
    passes around its seeds is then compared over the whole text and item. Tokens are runs of letters and digits,
    so punctuation and case of A-Z don't count. Items of equal tokens count once, under the smallest id. Rows that
    repeat a document's id are taken together. Null and empty texts overlap with nothing; empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    items = materialise(benchmark_items(benchmark, item_column, item_text), "benchmark-items")

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            at = column.offsets.to_numpy().astype(np.int64)
            tokens = column.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
            first = at - at[0]
            owner = np.repeat(np.arange(b.num_rows), np.diff(first))
            for _, place, h in seeds(tokens, first):
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), b.column(0).take(pa.array(owner[place])), pa.array((place - first[owner[place]]).astype(np.int32))], ["seed", "item_id", "item_at"])

    kind = items.schema["item_id"].dataType.simpleString()
    wanted = materialise(items.mapInArrow(item_seeds, f"seed long, item_id {kind}, item_at int"), "benchmark-seeds")
    slots = wanted.select(F.shiftrightunsigned("seed", 64 - BITS).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()  # at most 2**BITS
    bitmap = np.zeros(1 << BITS, dtype=bool)
    bitmap[slots] = True
    sent = spark.sparkContext.broadcast(np.packbits(bitmap))
    id_kind = docs.schema[id_column].dataType.simpleString()

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).view(bool)
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc"))
            for lo, _, tokens, first in token_arrays(b, "text"):
                hit_at, hit_seed = [], []
                for _, place, h in seeds(tokens, first):
                    good = np.flatnonzero(known[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                    hit_at.append(place[good])
                    hit_seed.append(h[good])
                place = np.concatenate(hit_at) if hit_at else np.zeros(0, np.int64)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, seed = place[order], np.concatenate(hit_seed)[order]
                owner = np.searchsorted(first, place, side="right") - 1
                new = np.ones(len(place), dtype=bool)  # a region ends where the text does, after a gap, or when it is long
                new[1:] = (owner[1:] != owner[:-1]) | (np.diff(place) > REACH) | (place[1:] // 2048 != place[:-1] // 2048)
                start = np.flatnonzero(new)
                stop = np.append(start[1:], len(place))
                left = np.maximum(place[start] - REACH, first[owner[start]])
                right = np.minimum(place[stop - 1] + REACH, first[owner[start] + 1])
                size = right - left
                at = np.concatenate([[0], np.cumsum(size)])
                take = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(left, size)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lo + owner[start])), pa.array(left - first[owner[start]]), lists(signed(tokens[take]), at), lists(signed(seed), np.append(start, len(place))), lists((place - np.repeat(left, stop - start)).astype(np.int32), np.append(start, len(place)))],
                    ["doc", "left", "tokens", "seeds", "places"],
                )

    texts = docs.select(F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h")).alias("doc"), F.col(text_column).alias("text"))
    doc_kind = texts.schema["doc"].dataType.simpleString()
    found = texts.mapInArrow(regions, f"doc {doc_kind}, left long, tokens array<long>, seeds array<long>, places array<int>")
    found = materialise(found.withColumn("region", F.xxhash64("doc", "left", "tokens")), "decontam-regions")
    hits = found.select("region", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("region", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    aligned = hits.join(wanted, "seed").groupBy("region", "item_id", (F.col("place") - F.col("item_at")).alias("shift")).agg(F.min("item_at").alias("low"), F.max("item_at").alias("high"))
    pairs = aligned.join(found.select("region", "doc", "left", F.col("tokens").alias("_tokens")).dropDuplicates(["region"]), "region").join(items, "item_id")

    def enough(size: int, item: np.ndarray) -> bool:
        return size >= max(SHORTEST, min(min_tokens, len(item)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, item = b.column(0), b.column(1)
            keep = []
            for n, (shift, low, high) in enumerate(zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                y = item[n].values.to_numpy()
                lo, hi = max(0, low - REACH), min(len(y), high + REACH)
                keep += [n] if enough(longest(text[n].values.to_numpy(), y[lo:hi], shift + lo, min_share)[0], y) else []
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i).take(rows) for i in (5, 6, 7)], ["doc", "item_id", "shift"])

    near_kind = f"doc {doc_kind}, item_id {kind}, shift long"
    good = pairs.select("_tokens", "tokens", "shift", "low", "high", "doc", "item_id", (F.col("shift") + F.col("left")).alias("whole_shift")).mapInArrow(near, near_kind)
    good = materialise(good.groupBy("doc", "item_id").agg(F.collect_set("shift").alias("shifts")), "decontam-alignments")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, tokens, first in token_arrays(b, "text"):
                sizes, equals = [], []
                for n in range(lo, hi):
                    text, item = tokens[first[n - lo] : first[n - lo + 1]].view(np.int64), b.column(2)[n].values.to_numpy()
                    size, equal = max(longest(text, item, shift, min_share) for shift in b.column(1)[n].as_py())
                    sizes.append(size)
                    equals.append(equal)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in (3, 4)), pa.array(sizes, pa.int64()), pa.array(equals, pa.int64())], [id_column, "item_id", "n_tokens", "n_equal"])

    checked = texts.join(good, "doc").dropDuplicates(["doc", "item_id"]).join(items, "item_id").select("text", "shifts", "tokens", F.col("doc.id").alias("id"), "item_id")
    checked = checked.mapInArrow(whole, f"`{id_column}` {id_kind}, item_id {kind}, n_tokens long, n_equal long")
    best = F.max(F.struct("n_tokens", "n_equal"))
    return checked.groupBy(id_column, "item_id").agg(best.alias("x")).select(id_column, "item_id", "x.n_tokens", "x.n_equal")


def longest(text: np.ndarray, item: np.ndarray, shift: int, share: float) -> tuple[int, int]:
    """Size and equal tokens of the longest stretch of the item, moved by shift into the text, with that share equal; it begins and ends with equal tokens."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi <= lo:
        return 0, 0
    same = item[lo:hi] == text[lo + shift : hi + shift]
    sums = np.concatenate([[0], np.cumsum(same)])
    ends = np.flatnonzero(same)
    if not len(ends):
        return 0, 0
    # a stretch a..b is good if good[b + 1] >= good[a] for good = sums - share * place
    good = sums - share * np.arange(len(sums))
    top = np.maximum.accumulate(good[ends + 1][::-1])[::-1]  # the best end from each end on
    last = np.searchsorted(-top, -(good[ends] - 1e-9), side="right") - 1
    fits = np.flatnonzero(last >= np.arange(len(ends)))
    if not len(fits):
        return 0, 0
    size = ends[last[fits]] + 1 - ends[fits]
    equal = sums[ends[last[fits]] + 1] - sums[ends[fits]]
    n = np.lexsort((equal, size))[-1]
    return int(size[n]), int(equal[n])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without those that overlap with a benchmark item; rows whose id is null stay."""
    return docs.join(overlaps(docs, benchmark, id_column, text_column).select(id_column).distinct(), id_column, "left_anti")
