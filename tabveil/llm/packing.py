"""Packing of documents into sequences of bounded length by sums of squares.

A document is a run of token ids and an end id; only one longer than a sequence is cut, into full pieces behind a
first one that may be shorter. A full piece is a sequence. All others are dealt out evenly to shards of bounded size.
A shard takes its pieces one by one, the longest eighth of the lengths first and in a hashed order within an eighth,
knowing of its open sequences only how many there are of each residual gap: a piece goes where the sum of the squares
of these numbers becomes smallest. That keeps gaps of all sizes at hand, so that nearly all sequences end up exactly
full. Those that are still open at a shard's end give their pieces back; these meet in fewer shards in the next round,
until one shard takes them all or a round fills less than half. There the pieces of open sequences are placed once
more, the longest first, each in the fullest sequence that takes it. So what stays empty is that of a few sequences of
one shard, not of each shard.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.bpe import PIECES, TOKENIZER, Bpe, text_groups, tokenizer_file
from tabveil.session import materialise, ship

SIZE, END = 1024, 2
#: Pieces that one task packs: some 20 MB there.
SHARD = 1 << 16
#: Steps of length in which pieces come, longest first.
STEPS = 8
#: In sequence ids: a full piece's own, and where the numbers of rounds and of shards begin.
FULL, ROUND, PART = 1 << 62, 56, 24
NO_BIN = np.int64(1) << np.int64(60)


@lru_cache(maxsize=1)
def encoder(spec: str) -> Callable[[str], list[int]]:
    """The ids that tokenizers gives for a text, its special tokens' strings read as those tokens.

    Where ids are numbered as their merges are ranked, tiktoken gives the same ids from the same vocabulary at four
    times the speed. A text whose white space is too long for its pattern engine goes to tokenizers, and so does all
    under another vocabulary.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(spec)
    slow.no_truncation()
    slow.no_padding()
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    try:
        known = Bpe(spec)
    except ValueError:
        return exact
    if len(known.made) and (np.diff(known.made) <= 0).any():
        return exact
    import tiktoken

    special = set(known.special.values())
    ranks = {b: i for i, b in enumerate(known.bytes_of) if b and i not in special}
    fast = tiktoken.Encoding("from_spec", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=known.special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return exact(text)

    return encode


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """uid, id_column, piece, start, length, ids: each document's ids and the end id in pieces of at most `size`; with digests ids_crc32 instead of ids.

    uid tells pieces apart while the table stays as it is; write it down before it is read twice.
    """
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path, TOKENIZER))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, uid = encoder(spec.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            key = batch.column(batch.schema.get_field_index(id_column))
            for lo, _, texts in text_groups(batch, text_column):
                row, number, start, length, content = [], [], [], [], []
                for i, text in enumerate(texts, lo):
                    ids = np.array([*encode(text), end], dtype="<u4")
                    cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        number.append(n)
                        start.append(a)
                        length.append(b - a)
                        content.append(zlib.crc32(ids[a:b].tobytes()) if digests else ids[a:b].astype(np.int32))
                uids = np.arange(uid, uid + len(row))
                uid += len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids, pa.int64()), key.take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(content, pa.int64() if digests else pa.list_(pa.int32()))],
                    ["uid", id_column, "piece", "start", "length", "ids_crc32" if digests else "ids"],
                )

    return docs.select(id_column, text_column).mapInArrow(run, f"uid long, `{id_column}` {kind}, piece int, start long, length long, " + ("ids_crc32 long" if digests else "ids array<int>"))


def sum_of_squares(lengths: list[int], size: int) -> tuple[list[list[int]], list[list[int]]]:
    """Full and open sequences, each as places in lengths (all below size): every piece goes where the squared counts of open sequences by gap become smallest; of equal choices, the smallest gap."""
    count, bins, full = np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)], []
    for i, s in enumerate(lengths):
        taken = count[s:size]
        change = np.where(taken > 0, 2 * (count[: size - s] - taken) + 2, NO_BIN)
        change[0] -= 1  # a full sequence is counted no more
        k = int(change.argmin())
        if change[k] <= 2 * count[size - s] + 1:
            into, gap = bins[s + k].pop(), k
            count[s + k] -= 1
        else:
            into, gap = [], size - s
        into.append(i)
        if gap:
            bins[gap].append(into)
            count[gap] += 1
        else:
            full.append(into)
    return full, [b for x in bins for b in x]


def best_fit(places: list[int], lengths: list[int], size: int) -> list[list[int]]:
    """Sequences of these pieces: in the order given, each into the sequence of the smallest gap that takes it."""
    bins, some, out = [[] for _ in range(size + 1)], 0, []  # bit g of some: there is a sequence of gap g
    for i in places:
        s = lengths[i]
        fits = some >> s
        if fits:
            gap = s + (fits & -fits).bit_length() - 1
            into = bins[gap].pop()
            if not bins[gap]:
                some ^= 1 << gap
        else:
            into, gap = [], size
            out.append(into)
        into.append(i)
        gap -= s
        bins[gap].append(into)
        some |= 1 << gap if gap else 0
    return out


def packer(turn: int, last: bool, size: int) -> Callable[[pa.Table], pa.Table]:
    """What a shard of one round does: uid, length, and the places of the pieces in sequences that are done."""

    def run(t: pa.Table) -> pa.Table:
        steps = -(t.column("length").to_numpy() * STEPS // size)
        t = t.take(pa.array(np.lexsort((t.column("uid").to_numpy(), t.column("h").to_numpy(), steps))))
        lengths, part = t.column("length").to_pylist(), t.column("shard")[0].as_py()
        full, still = sum_of_squares(lengths, size)
        if last:
            full += best_fit(sorted((i for b in still for i in b), key=lambda i: (-lengths[i], i)), lengths, size)
        at, offset = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
        for number, b in enumerate(full):
            at[b], offset[b] = (turn << ROUND) | (part << PART) | number, np.cumsum([0, *[lengths[i] for i in b[:-1]]])
        return pa.table([t.column("uid"), t.column("length"), pa.array(at, pa.int64(), mask=at < 0), pa.array(offset, pa.int64(), mask=at < 0)], names=["uid", "length", "sequence_id", "offset"])

    return run


def pack(items: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """uid, sequence_id, offset of items (uid, length), uid unique and 0 < length < size: no sequence over size, no gap before the last piece."""
    spark = items.sparkSession
    ship(spark)
    done, n, turn, stalled = None, items.count(), 0, False
    while True:
        shards = max(1, math.ceil(n / shard))
        last = shards == 1 or stalled
        dealt = items.select("uid", "length", F.xxhash64("uid").alias("h"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"))
        out = materialise(dealt.groupBy("shard").applyInArrow(packer(turn, last, size), "uid long, length long, sequence_id long, offset long"), "packed")
        here = out.where("sequence_id IS NOT NULL").select("uid", "sequence_id", "offset")
        done = here if done is None else done.unionByName(here)
        if last:
            return done
        items = out.where("sequence_id IS NULL").select("uid", "length")
        left = items.count()
        n, turn, stalled = left, turn + 1, 2 * left > n


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, id_column: str = "doc_id", text_column: str = "text", digests: bool = False, shard: int = SHARD) -> DataFrame:
    """id_column, piece, start, length, ids (with digests ids_crc32, of unsigned little-endian 32-bit ids), sequence_id, offset: one row a piece.

    Null and empty texts are a lone end id. Rows of equal ids or texts are documents of their own, null ids too; an
    empty table gives no rows; other columns are not read. Pieces of one document may lie in different sequences.
    """
    cut = materialise(pieces(docs, path, size, end, id_column, text_column, digests), "pieces")
    placed = pack(cut.where(F.col("length") < size).select("uid", "length"), size, shard)
    own = cut.where(F.col("length") == size).select("uid", F.col("uid").bitwiseOR(F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.join(placed.unionByName(own), "uid").drop("uid")
