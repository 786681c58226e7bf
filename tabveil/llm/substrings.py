"""Exact substring dedup: bytes covered by a string of `width` bytes that also starts earlier.

Every window of `width` bytes is represented by the leftmost smallest hash of its `GRAM`-byte pieces, its anchor; equal
windows have equal anchors, and neighbouring windows with one and the same anchor form a span. So equal windows can be
looked for among the spans of one anchor alone:

1. anchors are counted, and those that occur once are done;
2. of equal spans all but the earliest are repeated throughout;
3. the different spans of one anchor go to one shard, whose suffix array is built by induced sorting; stretches of it
   with permuted common prefixes of `width` or more are the repeated windows, and all but the earliest start count;
4. an anchor with so many different spans that they may not fit into a shard has its windows compared one by one, as
   hashes of 128 bits.

Spans are moved only where a bitmap of fixed size lets them through, texts only once, to be cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.bytesarrays import B, B_INV, BYTE, M1, M2, chunks, gram_hashes, mix, powers
from tabveil.llm.suffixarray import permuted_prefixes, suffix_array
from tabveil.session import discard, materialise, ship

WIDTH, GRAM = 100, 40
BITMAP_BITS = 27
SHARD_BYTES = 1 << 20
#: Different spans of one anchor from which its windows are compared one by one.
MANY_SPANS = 4096
B2 = 0xD1B54A32D192ED03 | 1
B2_INV = pow(B2, -1, 1 << 64)
BYTE2 = mix(BYTE ^ M2)


def spans(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner (text), begin (in data), number of windows and anchor of each span of texts that begin at `at`."""
    none = np.zeros(0, np.int64)
    windows = len(data) - width + 1
    if windows <= 0:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, GRAM)
    bits = np.uint64(max(26, len(data).bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    need, have = width - GRAM + 1, 1
    while 2 * have <= need:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if need > have:
        key = np.minimum(key[: len(key) - (need - have)], key[need - have :])
    place = (key[:windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(windows + 1, np.int32)  # windows that lie within one text
    lo, hi = at[:-1], at[1:] - width + 1
    some = hi > lo
    inside[lo[some]] += 1
    inside[hi[some]] -= 1
    inside = np.cumsum(inside[:windows]) > 0
    new = np.ones(windows, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(new & inside)
    last = np.ones(windows, dtype=bool)
    last[:-1] = new[1:] | ~inside[1:]
    n = np.flatnonzero(last & inside) - begin + 1
    return np.searchsorted(at, begin, side="right") - 1, begin, n, h[place[begin]]


class Hashes:
    """Two independent 64-bit hashes of any stretches of data."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for table, base in ((BYTE, B), (BYTE2, B2)):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * powers(base, len(data)), out=s[1:])
            self.sums.append(s)

    def of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (end - begin).astype(np.uint64) * M1
        n = int(begin.max(initial=0)) + 1
        return tuple(mix((s[end] - s[begin]) * powers(inverse, n)[begin] + size).view(np.int64) for s, inverse in zip(self.sums, (B_INV, B2_INV), strict=True))


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Packed bits, of fixed size, of the highest bits of all values."""
    low = 15
    parts = df.select(F.shiftrightunsigned(column, 64 - BITMAP_BITS).cast("int").alias("slot")).select(F.shiftrightunsigned("slot", low).alias("part"), F.col("slot").bitwiseAND((1 << low) - 1).alias("bit"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            part, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(part, kind="stable")
            part, bit = part[order], bit[order]
            edges = np.flatnonzero(np.diff(part)) + 1
            for p, x in zip(part[np.concatenate([[0], edges])].tolist() if len(part) else [], np.split(bit, edges), strict=False):
                found.setdefault(p, np.zeros(1 << low, bool))[x] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], ["part", "bits"])

    out = np.zeros((1 << (BITMAP_BITS - low), (1 << low) // 8), np.uint8)
    for r in parts.distinct().repartition("part").mapInArrow(gather, "part int, bits binary").collect():  # 16 MB
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1


def repeated_windows(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """doc (a struct of the id and a hash of the text), runs (start, n): its runs of n windows that also start earlier."""
    spark = docs.sparkSession
    texts = docs.select(F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h")).alias("doc"), F.col(text_column).alias("text"))
    doc_type = texts.schema["doc"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, at in chunks(b, "text"):
                anchor, n = np.unique(spans(data, at, width)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["anchor", "n"])

    again = texts.select("text").mapInArrow(anchors, "anchor long, n byte").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    again = materialise(again, "anchors")
    known = spark.sparkContext.broadcast(bitmap(again, "anchor"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, at in chunks(b, "text"):
                owner, begin, n, anchor = spans(data, at, width)
                keep = np.flatnonzero(passes(known.value, anchor))
                owner, begin, n, anchor = owner[keep], begin[keep], n[keep], anchor[keep]
                c1, c2 = Hashes(data).of(begin, begin + n + width - 1)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(c1), pa.array(c2), b.column(0).take(pa.array(lo + owner)), pa.array(begin - at[owner]), pa.array(n.astype(np.int32))], ["anchor", "c1", "c2", "doc", "start", "n"])

    found = texts.mapInArrow(candidates, f"anchor long, c1 long, c2 long, doc {doc_type}, start long, n int").join(again, "anchor")
    found = materialise(found, "spans")
    content = ["anchor", "c1", "c2"]
    first = materialise(found.groupBy(*content).agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n")), "contents")
    copies = found.join(first.where("copies > 1").select(*content, "first"), content).where(F.struct("doc", "start") > F.col("first")).select("doc", "start", "n")

    different = first.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1")
    inner = materialise(first.join(different, "anchor").select(*content, "first", "n", "different"), "inner")
    volume = inner.agg(F.sum(F.col("n") + width)).first()[0] or 0
    shards = max(1, math.ceil(volume / SHARD_BYTES))
    wanted = spark.sparkContext.broadcast(bitmap(inner, "c1"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, at in chunks(b, "text"):
                _, begin, n, anchor = spans(data, at, width)
                keep = np.flatnonzero(passes(known.value, anchor))
                begin, n, anchor = begin[keep], n[keep], anchor[keep]
                c1, c2 = Hashes(data).of(begin, begin + n + width - 1)
                keep = np.flatnonzero(passes(wanted.value, c1))
                _, one = np.unique(c1[keep] ^ c2[keep], return_index=True)  # a copy in one piece of the input is enough
                keep = keep[one]
                size = n[keep] + width - 1
                edge = np.concatenate([[0], np.cumsum(size)])
                take = np.arange(edge[-1]) - np.repeat(edge[:-1] - begin[keep], size)
                body = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data[take])])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), pa.array(c1[keep]), pa.array(c2[keep]), body], [*content, "body"])

    bodies = texts.select("text").mapInArrow(contents, "anchor long, c1 long, c2 long, body binary")
    bodies = bodies.join(inner, content).groupBy(*content).agg(F.first("body").alias("body"), F.first("first").alias("first"), F.first("n").alias("n"), F.first("different").alias("different"))
    bodies = materialise(bodies.select("anchor", "body", F.col("first.doc").alias("doc"), F.col("first.start").alias("start"), "n", "different"), "bodies")

    def shard(t: pa.Table) -> pa.Table:
        body, start = t.column("body").to_pylist(), t.column("start").to_numpy()
        keys = [(d["id"] is not None, d["id"] if d["id"] is not None else 0, d["h"]) for d in t.column("doc").to_pylist()]
        number = {k: n for n, k in enumerate(sorted(set(keys)))}
        doc = np.array([number[k] for k in keys], np.int64)
        size = np.array([len(x) + 1 for x in body])
        edge = np.concatenate([[0], np.cumsum(size)])
        s = np.zeros(edge[-1] + 1, np.int64)  # bytes as 2 to 257, each body's end as 1, the end of all as 0
        s[:-1] = np.frombuffer(b"\0".join(body) + b"\0", np.uint8).astype(np.int64) + 2
        s[edge[1:] - 1] = 1
        sa = suffix_array(s, 258)
        interval = np.cumsum(permuted_prefixes(s, sa, width)[sa] < width)
        owner = np.minimum(np.searchsorted(edge, sa, side="right") - 1, len(body) - 1)
        offset = sa - edge[owner]
        whole = offset + width < size[owner]
        owner, interval, place = owner[whole], interval[whole], (start[owner] + offset)[whole]
        order = np.lexsort((place, doc[owner], interval))
        later = np.zeros(len(order), dtype=bool)
        later[1:] = interval[order[1:]] == interval[order[:-1]]
        got = order[later]
        got = got[np.lexsort((place[got], doc[owner[got]]))]
        new = np.ones(len(got), dtype=bool)
        new[1:] = (doc[owner[got[1:]]] != doc[owner[got[:-1]]]) | (place[got[1:]] != place[got[:-1]] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(got)))
        return pa.table([t.column("doc").take(pa.array(owner[got[begin]], pa.int64())), pa.array(place[got[begin]], pa.int64()), pa.array(n.astype(np.int32))], names=["doc", "start", "n"])

    cut = bodies.where(F.col("different") <= MANY_SPANS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sorted_out = cut.groupBy("shard").applyInArrow(shard, f"doc {doc_type}, start long, n int")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("body"))
            for lo in range(0, b.num_rows, 1024):
                body = column.slice(lo, 1024)
                size = np.array([len(x.as_buffer()) for x in body])
                data = np.frombuffer(b"".join(x.as_py() for x in body), np.uint8)
                edge = np.concatenate([[0], np.cumsum(size)])
                n = size - width + 1
                owner = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                begin = edge[owner] + offset
                w1, w2 = Hashes(data).of(begin, begin + width)
                rows = pa.array(lo + owner)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), b.column(b.schema.get_field_index("doc")).take(rows), pa.array(b.column(b.schema.get_field_index("start")).to_numpy()[lo + owner] + offset)], ["w1", "w2", "doc", "start"])

    windows = bodies.where(F.col("different") > MANY_SPANS).select("body", "doc", "start").mapInArrow(single, f"w1 long, w2 long, doc {doc_type}, start long")
    windows = materialise(windows, "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    compared = windows.join(earliest, ["w1", "w2"]).where(F.struct("doc", "start") > F.col("first")).select("doc", "start", F.lit(1).alias("n"))
    runs = copies.unionByName(sorted_out).unionByName(compared).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    runs = materialise(runs, "runs")
    discard(again, found, first, inner, bodies, windows)
    return runs


def covered(size: int, start: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes under the windows."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    lo, hi = start[order], np.maximum.accumulate((start + n + width - 1)[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    begin = np.flatnonzero(new)
    return lo[begin], hi[np.append(begin[1:], len(lo)) - 1]


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, digests: bool = False) -> DataFrame:
    """Each text without the bytes under a `width`-byte string that also starts earlier: id, n_bytes, n_removed, n_spans, and kept or its SHA-256.

    Earlier is a smaller id (null first), or an earlier start in the same text; strings are judged on the input. Texts
    are UTF-8 bytes (kept is binary: a cut may fall within a character) and null is empty; matches never cross texts.
    Rows that repeat an id with different texts are ordered by a hash of these; rows that repeat both are one text and
    get equal results. Other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(id_column, text_column)
    runs = repeated_windows(docs.where(F.length(text_column) > 0), id_column, text_column, width)
    x = docs.withColumn("doc", F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h"))).join(runs, "doc", "left").select(id_column, text_column, "runs")
    kind = docs.schema[id_column].dataType.simpleString()
    last = "kept_sha256 string" if digests else "kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], [], [], []]
            for text, found in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_py().encode() if text.is_valid else b""
                start = n = np.zeros(0, np.int64)
                if found.is_valid:
                    start, n = (found.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                lo, hi = covered(len(raw), start, n, width)
                kept, at = [], 0
                for p, q in zip(lo.tolist(), hi.tolist(), strict=True):
                    kept.append(raw[at:p])
                    at = q
                body = b"".join([*kept, raw[at:]])
                for c, v in zip(columns, (len(raw), len(raw) - len(body), len(lo), hashlib.sha256(body).hexdigest() if digests else body), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string() if digests else pa.binary())], [id_column, "n_bytes", "n_removed", "n_spans", last.split()[0]])

    return x.mapInArrow(cut, f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, {last}")
