import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabveil.llm import packing
from tabveil.llm.bpe import TOKENIZER, tokenizer_file

SLOW = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
SLOW.no_truncation()
SLOW.no_padding()
ids_of = lambda text: [*SLOW.encode(text or "", add_special_tokens=False).ids, 2]


def check_layout(rows, size):
    """Sequences without gaps or overlaps, none over size; returns how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def best_fit_count(lengths, size):
    gaps = []
    for s in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(size - s)
    return len(gaps)


TEXTS = ["", None, "one two", "a<|endoftext|>b", "word " * 1000, "x " * 50, "Ünï " * 400, "same text", "same text"]


def test_pieces_are_those_of_the_tokenizer(spark):
    rows = [(i if i < 7 else 7, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(df, size=64, shard=16).collect()
    check_layout(got, 64)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS[:7]):
        mine = sorted(found[i], key=lambda r: r.piece)
        want = ids_of(t)
        assert [x for r in mine for x in r.ids] == want and [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == list(np.cumsum([0, *[r.length for r in mine]])[:-1])
        assert all(r.length == 64 for r in mine[1:]) and len(mine) == -(-len(want) // 64)
    assert len(found[7]) == 2 and found[None][0].ids == ids_of("no id")
    digests = packing.pack_documents(df, size=64, digests=True)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in digests.collect()} == {(r.doc_id, r.piece, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_many_shards_need_few_sequences_more_than_best_fit_over_all(spark):
    r = np.random.default_rng(3)
    lengths = r.integers(1, 64, 6000).tolist()
    df = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long").repartition(5)
    got = packing.pack(df, 64, 2000).join(df, "uid").collect()
    assert len(got) == 6000
    n = check_layout(got, 64)
    assert -(-sum(lengths) // 64) <= n <= best_fit_count(lengths, 64) * 1.01


@pytest.mark.parametrize("length, per", [(40, 1), (30, 2), (63, 1), (1, 64)])
def test_lengths_that_never_fill_a_sequence_end_too(spark, length, per):
    df = spark.range(900).select(F.col("id").alias("uid"), F.lit(length).cast("long").alias("length"))
    got = packing.pack(df, 64, 100).join(df, "uid").collect()
    assert len(got) == 900 and check_layout(got, 64) <= -(-900 // per) + (per == 64) * 9


def test_a_piece_goes_where_the_squares_become_smallest():
    r = np.random.default_rng(1)
    for _ in range(20):
        lengths = r.integers(1, 16, 40).tolist()
        full, still = packing.sum_of_squares(lengths, 16)
        bins, closed = [], []  # brute force: [gap, places]
        for i, s in enumerate(lengths):
            def total(gaps):
                return sum(gaps.count(g) ** 2 for g in set(gaps) if g)
            gaps = [g for g, _ in bins]
            options = [(total([*gaps[:n], g - s, *gaps[n + 1 :]]), 0, g, -len(bins) + n) for n, g in enumerate(gaps) if g >= s] + [(total([*gaps, 16 - s]), 1, 0, 0)]
            best = min(options)
            n = len(bins) + best[3] if best[1] == 0 else len(bins)
            if best[1]:
                bins.append([16, []])
            bins[n][0] -= s
            bins[n][1].append(i)
            if not bins[n][0]:
                closed.append(bins.pop(n)[1])
        sums = lambda x: sorted(sum(lengths[i] for i in b) for b in x)
        assert len(full) == len(closed) and sums(still) == sums([p for _, p in bins])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizers_library(text):
    assert [*packing.encoder(tokenizer_file(None, TOKENIZER))(text), 2] == ids_of(text)


def test_ids_of_long_runs():
    encode = packing.encoder(tokenizer_file(None, TOKENIZER))
    for text in ("x" * 20000, " " * 20000, " " * 1_500_000 + "y", "\n" * 9000 + "é" * 9000, "1" * 9000):
        assert encode(text) == SLOW.encode(text, add_special_tokens=False).ids
