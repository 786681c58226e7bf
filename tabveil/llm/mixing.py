"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of yes/no decisions. Frequent words and the end of the text are leaves of a Huffman tree; other
words are an escape, their bytes and an end, from a tree of their own. Where the words before are known, the text so far
or the corpus foretells the next word, and the first decision is whether it comes. Predictors give log odds for each
decision: the corpus's counts, and what the text itself has decided there so far, in general and after the same word
(or the same two bytes): counts under hashed contexts, empty when the text begins.

The corpus foretells the word after any three words: by the one that most training texts have there, where each text has
one vote, for what follows the first time. The votes grow with the corpus: they go by the hash of the three words into
buckets of bounded size, in which Spark counts them and answers what the texts ask.

The log odds are added up with weights that a gate (the kind of decision) picks, and corrected by a map from their own
sum; weights, map and counts are refined after each block of symbols, the first ones small. Every text begins with the
same weights, so a score depends on the text and the corpus only. As an online model codes a text before it learns from
it, a training text's own votes are taken out, and ties are broken by the words themselves: what is foretold to a text
depends on the other texts alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.bytesarrays import LOWER, M1, M2, chunks, mix, together, word_hashes, words
from tabveil.session import discard, materialise, ship

#: So many of the most frequent words are sent to all tasks; the counts of others are joined.
FREQUENT = 1 << 18
#: So many of these are symbols of their own; other words are spelled.
VOCABULARY = (1 << 16) - 2
#: Votes that a bucket is meant to have, and different ones that are gathered before equal ones are put together.
BUCKET_VOTES, GATHERED = 1 << 20, 1 << 22
#: Packed rows: a vote, and the answer to a question (the two most voted symbols, and how often).
VOTE = np.dtype([("context", "<u4"), ("symbol", "<u2")])
ANSWER = np.dtype([("context", "<u4"), ("best", "<u2"), ("second", "<u2"), ("often", "u1")])
#: Bytes of text that are scored together, and decisions that are laid out at a time.
PIECE, LAID_OUT = 1 << 19, 1 << 16
#: Blocks of symbols: at first from 8 on, then of BLOCK.
BLOCK = 128
#: No word has more decisions, as a path that long needs 2**43 words. All of them are mixed.
TOP = 64
#: Blocks of a text's first symbols, up to that which begins at BLOCK.
FIRST = np.ceil(np.log2(np.maximum(np.arange(1, BLOCK + 2), 8) / 8)).astype(np.int64)
FIRST[BLOCK] = int(np.log2(BLOCK // 8)) + 1
#: Gates: the first HEAD decisions of a word, those on its bytes, whether what is foretold comes, and a word's other decisions.
GATES, HEAD = 4, 3
ONE = np.float32(1)
#: Log odds at first that a foretold word comes: from this text, then from the corpus once, two or three times, oftener; by success so far, as training texts of 40 MB had them.
FORETOLD = (-1.7, 1.5, 2.2, 3.8, 0.2, 2.5, 1.5, 2.8, -0.4, 2.0, -0.2, 1.3, 1.5, 3.6, 1.7, 2.6)
#: Weights of the predictors at a text's begin.
START = (1.0, 0.5, 0.5)
RATE, MAP_RATE, BUCKETS = 0.01, 0.02, 25
END = np.uint64(0x9AE16A3B2F90404F)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each leaf's path as (first, nodes, bits), nodes[first[i]:first[i + 1]], and each inner node's log odds of 1; the root is 0."""
    n = len(counts)
    weight = np.concatenate([np.sort(counts.astype(np.float64)) + 0.5, np.zeros(n - 1)])
    leaf = np.argsort(counts, kind="stable")
    parent, bit, odds = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8), np.zeros(n - 1, np.float32)
    w, a, b = weight.tolist(), 0, n  # the lightest leaf and the lightest inner node that have no parent
    for new in range(n, 2 * n - 1):
        pair = []
        for _ in range(2):
            if a < n and (b >= new or w[a] <= w[b]):
                pair.append(a)
                a += 1
            else:
                pair.append(b)
                b += 1
        w[new] = w[pair[0]] + w[pair[1]]
        parent[pair], bit[pair] = new, (0, 1)
        odds[2 * n - 2 - new] = np.log(w[pair[1]] / w[pair[0]])
    depth = np.zeros(2 * n - 1, np.int64)
    for x in range(2 * n - 3, -1, -1):
        depth[x] = depth[parent[x]] + 1
    of = np.empty(n, np.int64)
    of[leaf] = np.arange(n)
    first = np.concatenate([[0], np.cumsum(depth[of])])
    nodes, bits = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int8)
    at, left = of.copy(), depth[of].copy()
    while (live := left > 0).any():
        place = first[:-1][live] + left[live] - 1
        bits[place] = bit[at[live]]
        at[live] = parent[at[live]]
        nodes[place] = 2 * n - 2 - at[live]
        left[live] -= 1
    return first, nodes, bits, odds


class Model:
    """What all tasks know: frequent words with their counts, the two trees and the log odds of their nodes.

    Symbols are the words by rank, then the escape and the end of the text, then 256 bytes, of which 32 ends a word.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, spelled: np.ndarray, n_texts: int, total: int):
        rank = np.argsort(-counts, kind="stable")
        n = min(len(keys), VOCABULARY)
        self.escape, self.end, self.bytes = n, n + 1, n + 2
        symbol = np.full(len(keys), n, np.int32)
        symbol[rank[:n]] = np.arange(n, dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.counts, self.symbol = keys[order], counts[order], symbol[order]
        self.start = np.searchsorted(self.keys, np.arange((1 << 20) + 1, dtype=np.uint64)[:-1] << np.uint64(44)).astype(np.int32)
        of_words = huffman(np.concatenate([counts[rank[:n]], [max(total - int(counts[rank[:n]].sum()), 0), n_texts]]))
        of_bytes = huffman(spelled)
        # a decision that isn't in a tree: whether what is foretold comes, by source, frequency and success
        of_flags = np.array(FORETOLD, np.float32)
        n_flags = len(of_flags)
        inner = len(of_words[3]), len(of_bytes[3])
        self.flags = self.bytes + 256
        edge = [of_bytes[0][1:], of_bytes[0][-1] + np.arange(1, 2 * n_flags + 1)]
        self.first = np.concatenate([of_words[0], *[e + of_words[0][-1] for e in edge]])
        self.nodes = np.concatenate([of_words[1], of_bytes[1] + inner[0], np.repeat(np.arange(n_flags), 2) + sum(inner)]).astype(np.int32)
        self.bits = np.concatenate([of_words[2], of_bytes[2], np.tile([0, 1], n_flags)]).astype(np.int8)
        self.path = self.nodes.astype(np.int64) << 1 | self.bits
        self.odds = np.concatenate([of_words[3], of_bytes[3], of_flags]).astype(np.float32)
        chance = (1 / (1 + np.exp(-self.odds))).astype(np.float32)
        self.chances = (1 - chance) + 1j * chance  # of no and of yes
        self.spread = mix(np.arange(1, len(self.odds) + 1, dtype=np.uint64))
        self.gate = np.repeat([0, 1, 2], [n + 2, 256, 2 * n_flags])  # of a symbol's first decisions

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word among the frequent ones, or -1."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        at = self.start[(h >> np.uint64(44)).astype(np.int64)]
        live = np.arange(len(h))
        while len(live):
            inside = at < len(self.keys)
            live, at = live[inside], at[inside]
            key = self.keys[at]
            hit = key == h[live]
            out[live[hit]] = at[hit]
            on = key < h[live]
            live, at = live[on], at[on] + 1
        return out


def tokens(data: np.ndarray, at: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    """Words and an end for each text: first, hash, symbol, begin and end in data, and the number among the frequent words."""
    begin, end, first = words(data, at)
    h = word_hashes(data, begin, end)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(h)) + text
    n = len(h) + len(first) - 1
    x = {"first": first + np.arange(len(first)), "hash": np.full(n, END), "symbol": np.full(n, model.end, np.int32), "known": np.full(n, -1, np.int32), "begin": np.zeros(n, np.int64), "end": np.zeros(n, np.int64)}
    known = model.find(h)
    x["hash"][place], x["begin"][place], x["end"][place], x["known"][place] = h, begin, end, known
    x["symbol"][place] = np.where(known >= 0, model.symbol[known] if len(model.symbol) else 0, model.escape)
    x["text"] = np.repeat(np.arange(len(first) - 1), np.diff(x["first"]))
    return x


def contexts(x: dict[str, np.ndarray], escape: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens after three words of their text, the hash of these, the text's vote on it (-1: a spelled word, which is none), and where the text votes."""
    h, first, text = x["hash"], x["first"], x["text"]
    place = np.flatnonzero(np.arange(len(h)) - first[text] >= 3)
    three = mix(h[place - 1] * M1 + h[place - 2] * M2 + h[place - 3])
    order, begin = together(mix(three + text[place].astype(np.uint64) * SPREAD))
    votes = order[begin]
    symbol, vote = x["symbol"][place[votes]], np.empty(len(place), np.int32)
    vote[order] = np.repeat(np.where(symbol == escape, -1, symbol), np.diff(np.append(begin, len(order))))
    return place, three, vote, votes


def in_buckets(context: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each context, its first bits, and the 32 bits after these."""
    return (context >> np.uint64(64 - bits)) if bits else np.zeros(len(context), np.uint64), ((context << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def binaries(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """values cut into binary values of these sizes."""
    edge = np.concatenate([[0], np.cumsum(size)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(values.tobytes())])


class Votes:
    """The votes of a bucket: each different one with its number, and the two that lead for each context."""

    def __init__(self):
        self.keys, self.size, self.merged, self.told = [], 0, None, None

    def add(self, votes: np.ndarray) -> None:
        self.keys.append((votes["context"].astype(np.uint64) << np.uint64(16)) | votes["symbol"].astype(np.uint64))
        self.size += len(votes)
        if self.size > GATHERED:
            self.merge()

    def merge(self) -> None:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.keys]), return_counts=True)
        if self.merged:
            n = np.append(self.merged[1], n)
            keys, where = np.unique(np.append(self.merged[0], keys), return_inverse=True)
            n = np.bincount(where, weights=n, minlength=len(keys)).astype(np.int64)
        self.keys, self.size, self.merged = [], 0, (keys, n)

    def leaders(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted contexts, and for each the first and the second vote as number << 16 | 65535 - symbol, so that ties go to the smaller symbol."""
        if self.told is None:
            self.merge()
            keys, n = self.merged
            context = (keys >> np.uint64(16)).astype(np.uint32)
            rank = (n << 16) | (65535 - (keys & np.uint64(65535)).astype(np.int64))
            begin = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
            best = np.maximum.reduceat(rank, begin) if len(begin) else rank
            rank[rank == np.repeat(best, np.diff(np.append(begin, len(rank))))] = 0
            self.told = context[begin], best, np.maximum.reduceat(rank, begin) if len(begin) else rank
        return self.told

    def answers(self, asked: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """The questions that have an answer and these; unless whole, none where there is one vote only.

        often holds the numbers of both up to 7, in three bits each, and whether the first leads without one of its votes.
        """
        context, best, second = self.leaders()
        at = np.minimum(np.searchsorted(context, asked), max(len(context) - 1, 0))
        good = np.flatnonzero(context[at] == asked) if len(context) else np.zeros(0, np.int64)
        if not whole:
            good = good[(best[at[good]] >> 16) + (second[at[good]] >> 16) > 1]
        a, b = best[at[good]], second[at[good]]
        out = np.zeros(len(good), ANSWER)
        out["context"], out["best"], out["second"] = asked[good], 65535 - (a & 65535), 65535 - (b & 65535)
        out["often"] = np.minimum(a >> 16, 7) | (np.minimum(b >> 16, 7) << 3) | ((a - 65536 > b) << 6)
        return good, out


def count_words(docs: DataFrame) -> DataFrame:
    """kind, key, n: counts of words (kind 0, by hash) and of all words' bytes (kind 1) of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, byte = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(256, np.int64)
        for b in batches:
            for _, _, data, at in chunks(b, "text"):
                begin, end, _ = words(data, at)
                k, n = np.unique(word_hashes(data, begin, end), return_counts=True)
                keys.append(k)
                counts.append(n)
                if sum(map(len, keys)) > 2_000_000:
                    keys, counts = merged(keys, counts)
                    if len(keys[0]) > 1_000_000:
                        yield rows(keys[0], counts[0], 0)
                        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                byte += np.bincount(LOWER[data], minlength=256)
        keys, counts = merged(keys, counts)
        yield rows(keys[0], counts[0], 0)
        yield rows(np.arange(256, dtype=np.uint64), byte, 1)

    def merged(keys, counts):
        k, where = np.unique(np.concatenate(keys), return_inverse=True)
        return [k], [np.bincount(where, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)]

    def rows(k, n, kind):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    return docs.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")


def in_pieces(texts: DataFrame) -> DataFrame:
    """texts with row, a number of the row, and piece, that of the PIECE bytes of text that it is scored with."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, _, _ in chunks(b, "text", PIECE):
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(np.arange(row, row + hi - lo)), pa.array(np.full(hi - lo, piece))], ["id", "text", "held_out", "row", "piece"])
                row, piece = row + hi - lo, piece + 1

    return materialise(texts.select("id", "text", "held_out").mapInArrow(run, f"id {kind}, text string, held_out boolean, row long, piece long"), "pieces")


def by_piece(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    piece = b.column(b.schema.get_field_index("piece")).to_numpy()
    edge = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)] if len(piece) else [0]
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        yield int(piece[lo]), b.slice(lo, hi - lo)


def corpus_answers(pieces: DataFrame, sent, bits: int) -> DataFrame:
    """piece, bucket, answers: what the training texts continue each context with that a piece holds, packed, in 2**bits buckets.

    Left out are contexts on which nobody has voted, or only one text and the piece's texts that ask have votes themselves.
    """

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for piece, part in by_piece(b):
                for lo, hi, data, at in chunks(part, "text"):
                    x = tokens(data, at, model)
                    place, context, vote, votes = contexts(x, model.escape)
                    held = part.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)[x["text"][place]]
                    order, begin = together(context)
                    cast = np.zeros(len(context), bool)
                    cast[votes] = ~held[votes] & (vote[votes] >= 0)
                    cast = order[cast[order]]
                    bucket, rest = in_buckets(context[cast], bits)
                    values = np.zeros(len(cast), VOTE)
                    values["context"], values["symbol"] = rest, vote[cast]
                    yield packed(bucket, values, 0, piece)
                    free = (held | (vote < 0))[order]
                    whole = np.logical_or.reduceat(free, begin) if len(begin) else free
                    asked = context[order[begin]]
                    for kind in (1, 2):
                        bucket, rest = in_buckets(asked[whole == (kind == 2)], bits)
                        yield packed(bucket, rest, kind, piece)

    def packed(bucket: np.ndarray, values: np.ndarray, kind: int, piece: int) -> pa.RecordBatch:
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(bucket)))
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int64)), pa.array(np.full(len(begin), kind, np.int8)), pa.array(np.full(len(begin), piece, np.int64)), binaries(values, size)], ["bucket", "kind", "piece", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, votes = -1, Votes()
        for b in batches:  # in order of bucket and kind
            key, kind, piece = (b.column(c).to_numpy() for c in range(3))
            _, where, data = b.column(3).buffers()
            where = np.frombuffer(where, np.int32)[b.column(3).offset :][: b.num_rows + 1]
            edge = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if key[lo] != bucket:
                    bucket, votes = int(key[lo]), Votes()
                part = memoryview(data)[where[lo] : where[hi]]
                if kind[lo] == 0:
                    votes.add(np.frombuffer(part, VOTE))
                    continue
                good, out = votes.answers(np.frombuffer(part, np.uint32), kind[lo] == 2)
                row = np.repeat(np.arange(hi - lo), np.diff(where[lo : hi + 1]) // 4)[good]
                size = np.bincount(row, minlength=hi - lo)
                some = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays([pa.array(piece[lo:hi][some]), pa.array(np.full(len(some), bucket)), binaries(out, size[some])], ["piece", "bucket", "answers"])

    rows = pieces.select("piece", "text", "held_out").mapInArrow(said, "bucket long, kind byte, piece long, data binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, "piece long, bucket long, answers binary")


def predicted(x: dict[str, np.ndarray], held: np.ndarray, rows: pa.Table, model: Model, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the symbol that is foretold (or -1), the number of the decision whether it comes, and whether it does.

    Foretold is what the corpus continues with, else the word that came in this text after the last equal pair of words;
    a word without a symbol comes if its letters do. The decision has a number for the source, how many other texts continue so, and how many tokens
    before were foretold rightly.
    """
    n, first, text = len(x["symbol"]), x["first"], x["text"]
    guess, often, ours = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
    h = x["hash"]
    two = np.zeros(n, np.uint64)  # the two words before a token
    two[2:] = mix(h[1:-1] * M1 + h[:-2] + text[2:].astype(np.uint64) * M2)
    some = np.flatnonzero(np.arange(n) - first[text] >= 2)
    order, begin = together(two[some])
    some, again = some[order], np.ones(len(some), bool)
    again[begin] = False
    same = np.flatnonzero(again) - 1
    guess[some[same + 1]] = x["symbol"][some[same]]
    right = np.zeros(n, bool)
    right[some[same + 1]] = h[some[same + 1]] == h[some[same]]
    place, context, vote, _ = contexts(x, model.escape)
    unknown = np.uint64(32 - bits)  # of a context's bits, the last ones
    packed = rows.column("answers").to_pylist()
    found = np.frombuffer(b"".join(packed), ANSWER)
    if len(place) and len(found):
        bucket = np.repeat(rows.column("bucket").to_numpy(), [len(v) // ANSWER.itemsize for v in packed]).astype(np.uint64)
        key = ((bucket << np.uint64(32)) | found["context"]) << unknown
        order, begin = together(np.append(key, (context >> unknown) << unknown))
        first_of = np.empty(len(order), np.int64)  # of equal ones, an answer if there is one
        first_of[order] = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
        at = first_of[len(key) :]
        good = np.flatnonzero(at < len(key))
        place, found, vote = place[good], found[at[good]], np.where(held[text[place[good]]], -1, vote[good])
        first_is, second_is = vote == found["best"], vote == found["second"]
        often_a, often_b = found["often"] & 7, (found["often"] >> 3) & 7
        use_a = ~first_is | (found["often"] >= 64)
        left = np.where(use_a, often_a - first_is.astype(np.int64), often_b - (second_is & (often_b > 0)).astype(np.int64))  # votes of other texts
        use = np.flatnonzero(left > 0)
        guess[place[use]] = np.where(use_a, found["best"], found["second"])[use]
        often[place[use]] = np.minimum(np.log2(left[use]), 2).astype(np.int32)
        ours[place[use]] = True
        right[place[use]] = guess[place[use]] == x["symbol"][place[use]]
    run = np.zeros(n, np.int32)
    for k in (1, 2, 4):  # rightly foretold are the one, the two and the four tokens before
        whole = np.ones(n, bool)
        for o in range(1, k + 1):
            whole[o:] &= right[:-o] & (text[o:] == text[:-o])
            whole[:o] = False
        run += whole
    return guess, np.where(ours, 1 + often, 0).astype(np.int32) * 4 + run, right


def laid_out(x: dict[str, np.ndarray], data: np.ndarray, model: Model, guess: np.ndarray, flag: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    """The symbols of all texts in order: symbol, text, each text's first, place in the text, context (the word or the two bytes before).

    A token that something is foretold for begins with the answer whether it comes, which is a symbol of its own; if so, it is all.
    """
    told = guess >= 0
    letters = np.where(x["symbol"] == model.escape, x["end"] - x["begin"] + 1, 0)
    size = np.where(right, 1, told + 1 + letters)
    edge = np.cumsum(size) - size
    token = np.repeat(np.arange(len(size), dtype=np.int32), size)
    inner = np.arange(len(token), dtype=np.int32) - (edge + told).astype(np.int32)[token]
    symbol = x["symbol"][token]
    answer = np.flatnonzero(inner < 0)
    symbol[answer] = model.flags + 2 * flag[token[answer]] + right[token[answer]]
    spelled = np.flatnonzero(inner > 0)
    before = np.append(END, x["hash"][:-1])
    before[x["first"][:-1]] = END
    context = before[token]
    if len(spelled):
        at = x["begin"][token[spelled]] + inner[spelled] - 1
        stop = at >= x["end"][token[spelled]]
        symbol[spelled] = model.bytes + np.where(stop, 32, LOWER[data[np.minimum(at, len(data) - 1)]]).astype(np.int32)
        context[spelled] = symbol[spelled - 1].astype(np.uint64) * M1 + np.where(inner[spelled] > 1, symbol[spelled - 2], 0).astype(np.uint64)
    first = np.append(edge, len(token))[x["first"]]
    text = x["text"][token].astype(np.int32)
    return {"symbol": symbol, "text": text, "first": first, "place": np.arange(len(token)) - first[text], "context": context * SPREAD}


def narrow(keys: np.ndarray) -> np.ndarray:
    """Small numbers in 16 bits, which are sorted by their digits."""
    return keys.astype(np.uint16) if keys.max(initial=0) < 65536 else keys


def code_lengths(s: dict[str, np.ndarray], model: Model) -> np.ndarray:
    """Nats of each text.

    Decisions lie by block, text and gate, so that what a gate's weights move by is a sum over neighbours.
    """
    n_texts, n = len(s["first"]) - 1, len(s["symbol"])
    weight = np.repeat(np.array(START, np.float32)[:, None], n_texts * GATES, axis=1)
    correction = np.zeros(n_texts * BUCKETS, np.float32)
    slots = 1 << np.ceil(np.log2(4 * np.maximum(np.diff(s["first"]), 8))).astype(np.int64)  # of each text's own counts
    base, mask = np.cumsum(slots) - slots, (slots - 1).astype(np.uint64)
    half = int(slots.sum())
    seen = np.zeros(4 * half, np.float32)  # noes and ayes in turn, without context and then with it
    pairs = seen.view(np.complex64)
    place = s["place"]
    block = FIRST[np.minimum(place, BLOCK)] + np.maximum(place // BLOCK - 1, 0)
    begin, size = model.first[s["symbol"]], np.diff(model.first)[s["symbol"]]
    deep = np.flatnonzero((s["symbol"] < model.bytes) & (size > HEAD))
    of = np.append(np.arange(n), deep)
    row = s["text"][of].astype(np.int64) * GATES + np.append(model.gate[s["symbol"]], np.full(len(deep), GATES - 1))
    size, below = np.append(size, size[deep] - HEAD), np.append(begin, begin[deep] + HEAD)
    size[deep] = HEAD
    order = np.argsort(narrow(row), kind="stable")
    order = order[np.argsort(narrow(block[of[order]]), kind="stable")]
    of, row, size, begin = of[order], row[order], size[order], below[order]
    block = block[of]
    upto = np.cumsum(size)
    begin -= upto - size
    new = np.append(True, block[1:] != block[:-1]) if len(of) else np.zeros(0, bool)
    ends = np.append(np.flatnonzero(new)[1:], len(of)) if len(of) else np.zeros(0, np.int64)  # of blocks
    new[1:] |= row[1:] != row[:-1]
    edge = np.flatnonzero(new)  # of the runs with a block, a text and a gate
    rows, start = row[edge], (upto - size)[edge]
    runs = np.diff(np.append(start, upto[-1:]))
    last = np.searchsorted(edge, ends)
    nats = np.zeros(n_texts)
    done = 0
    while done < len(ends):
        lo, i = (int(ends[done - 1]), int(last[done - 1])) if done else (0, 0)
        before = int(upto[lo - 1]) if lo else 0
        stop = max(done + 1, int(np.searchsorted(upto[ends - 1], before + LAID_OUT, side="right")))
        hi, j = int(ends[stop - 1]), int(last[stop - 1])
        path = np.repeat(begin[lo:hi], size[lo:hi])
        path += np.arange(before, before + len(path))
        both = model.path.take(path, mode="clip")
        node, bit = both >> 1, both & 1
        odds, chances, h = (c.take(node, mode="clip") for c in (model.odds, model.chances, model.spread))
        sign = (2 * bit - 1).astype(np.float32)
        text = rows[i:j] // GATES
        low_bits, from_slot, from_bucket = (np.repeat(c, runs[i:j]) for c in (mask[text], base[text], text * BUCKETS))
        slot, count = np.empty((2, len(path)), np.int64), np.empty((2, len(path)), np.int64)
        for k in (0, 1):
            np.add(((h >> np.uint64(33)) & low_bits).view(np.int64), from_slot, out=slot[k])
            if k == 0:
                h ^= np.repeat(s["context"][of[lo:hi]], size[lo:hi])
                h *= SPREAD
        slot[1] += half
        np.multiply(slot, 2, out=count)
        count += bit
        at = 0
        for e, k in zip((upto[ends[done:stop] - 1] - before).tolist(), last[done:stop].tolist(), strict=True):
            r, run, first = rows[i:k], runs[i:k], start[i:k] - (before + at)
            low, high = int(r[0]) // GATES * BUCKETS, (int(r[-1]) // GATES + 1) * BUCKETS
            x = np.empty((3, e - at), np.float32)
            x[0] = odds[at:e]
            for m in (1, 2):
                c = pairs.take(slot[m - 1, at:e], mode="clip")
                c += chances[at:e]
                np.divide(c.imag, c.real, out=x[m])
                np.log(x[m], out=x[m])
                x[m] -= x[0]
            z = np.repeat(weight[0, r], run)
            z *= x[0]
            for m in (1, 2):
                y = np.repeat(weight[m, r], run)
                y *= x[m]
                z += y
            y = z * 1.5
            y += BUCKETS / 2
            bucket = np.clip(y, 0, BUCKETS - 1, out=y).astype(np.int64)
            bucket += from_bucket[at:e]
            z += correction.take(bucket, mode="clip")
            z *= sign[at:e]
            miss = np.exp(np.minimum(np.negative(z, out=z), 30, out=z), out=z)
            more = 1 + miss
            error = np.divide(miss, more, out=miss)
            error *= sign[at:e]
            np.add.at(nats, r // GATES, np.add.reduceat(np.log(more, out=more), first))
            for m in range(3):
                x[m] *= error
                weight[m, r] += np.clip(RATE * np.add.reduceat(x[m], first), -0.3, 0.3)
            bucket -= low
            step = np.bincount(bucket, weights=error, minlength=high - low)
            correction[low:high] += np.clip(MAP_RATE * step, -0.3, 0.3).astype(np.float32)
            for w in count:
                np.add.at(seen, w[at:e], ONE)
            at, i = e, k
        done = stop
    return nats


def held_out(id_column: str = "doc_id"):
    """crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row for each row of docs.

    Tokens are words between white space (0x20, 0x09 to 0x0D), A-Z lower-cased, and one end of text; counts come from
    the rows that aren't held out. base_score adds up log10((c + 1) / (N + V + 1)); score is the model's log10
    probability of the same tokens, and bits_per_byte spreads it over the words and one separator each. Null and empty
    texts have the end alone. Repeated rows are counted and scored each; a null id is for training. An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = in_pieces(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), held_out(id_column).alias("held_out")))
    kind = texts.schema["id"].dataType.simpleString()
    train = texts.where(~F.col("held_out")).select("text")
    counts = materialise(count_words(train), "word-counts", tidy=True)
    n_texts = train.count()
    total, distinct = counts.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, vocabulary = int(total) + n_texts, int(distinct) + (n_texts > 0)
    top = counts.where("kind = 0").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toArrow()
    byte = np.zeros(256, np.int64)
    for r in counts.where("kind = 1").collect():  # at most 256
        byte[r.key] = r.n
    byte[32] = int(total)
    sent = spark.sparkContext.broadcast(Model(top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy(), byte, n_texts, int(total)))
    bits = max(0, math.ceil(math.log2(max(train_tokens, 1) / BUCKET_VOTES)))
    end_score = float(np.log10(n_texts + 1))

    def solve(piece: pa.Table, rows: pa.Table) -> pa.Table:
        model = sent.value
        out: dict[str, list] = {c: [] for c in ("nats", "n_stream", "n_tokens", "known", "logs", "rare")}
        for b in piece.combine_chunks().to_batches():
            for lo, hi, data, at in chunks(b, "text"):
                x = tokens(data, at, model)
                n, text, known = hi - lo, x["text"], x["known"]
                is_word = x["hash"] != END
                frequent, other = np.flatnonzero(known >= 0), np.flatnonzero((known < 0) & is_word)
                out["n_tokens"].append(np.diff(x["first"]))
                out["known"].append(np.bincount(text[frequent], minlength=n))
                out["logs"].append(np.bincount(text[frequent], weights=np.log10(model.counts[known[frequent]] + 1.0), minlength=n))
                edge = np.searchsorted(text[other], np.arange(n + 1)).astype(np.int32)
                out["rare"].append(pa.ListArray.from_arrays(pa.array(edge), pa.array(x["hash"][other].view(np.int64))))
                out["n_stream"].append(np.bincount(text, weights=x["end"] - x["begin"] + 1, minlength=n))
                held = b.column(b.schema.get_field_index("held_out")).slice(lo, n).to_numpy(zero_copy_only=False)
                out["nats"].append(code_lengths(laid_out(x, data, model, *predicted(x, held, rows, model, bits)), model))
        join = lambda c, t: pa.array(np.concatenate(out[c] or [np.zeros(0)]).astype(t))
        rare = pa.chunked_array(out["rare"], pa.list_(pa.int64()))
        return pa.table([piece.column("id"), piece.column("held_out"), piece.column("row"), join("n_tokens", np.int64), join("known", np.int64), join("logs", np.float64), rare, join("nats", np.float64), join("n_stream", np.float64)],
                        names=["id", "held_out", "row", "n_tokens", "known", "logs", "rare", "nats", "n_stream"])

    rows = materialise(corpus_answers(texts, sent, bits), "answers", tidy=True)
    scored = texts.groupBy("piece").cogroup(rows.groupBy("piece")).applyInArrow(solve, f"id {kind}, held_out boolean, row long, n_tokens long, known long, logs double, rare array<long>, nats double, n_stream double")
    scored = materialise(scored, "scored", tidy=True)
    discard(texts, rows)
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    rare = rare.join(counts.where("kind = 0").select("key", "n"), "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("times").alias("more_known"))
    x = scored.drop("rare").join(rare, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end_score) - F.col("n_tokens") * F.log10(F.lit(float(train_tokens + vocabulary + 1)))
    n_known = F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_texts > 0))
    return x.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (-F.col("nats") / F.lit(float(np.log(10)))).alias("score"), (F.col("nats") / F.lit(float(np.log(2))) / F.col("n_stream")).alias("bits_per_byte"),
    )
