import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tabveil.llm import tokencounts


@pytest.mark.parametrize("segment", [1, 2, 1024])
def test_against_a_plain_scan(spark, segment, tmp_path):
    r = random.Random(segment)
    rows, want = [], []
    for f in range(4):
        tokens = [r.choice([7, 8, 9, 0, 9, 9, 9]) if f else 5 for _ in range(r.randint(1, 90))] + [0] * (f == 2)
        size = r.choice([1, 3, 8])
        rows += [(f, n, np.array(tokens[lo : lo + size], "<u2").tobytes(), "x") for n, lo in enumerate(range(0, len(tokens), size))]
        np.array(tokens, "<u2").tofile(tmp_path / f"{f}.bin")
        n = number = 0
        for t in tokens:
            if t == 0:
                want.append((f, number, n, True))
                n, number = 0, number + 1
            else:
                n += 1
        want += [(f, number, n, False)] if n else []
    rows += [(9, 0, b"", "x"), (9, 1, None, "x")]
    r.shuffle(rows)
    blocks = spark.createDataFrame(rows, "file int, block long, data binary, n string")
    got = sorted(tuple(x) for x in tokencounts.document_lengths(blocks, end=0, segment=segment).collect())
    assert got == sorted(want)
    read = tokencounts.document_lengths(tokencounts.read_token_files(spark, str(tmp_path), block_tokens=4), end=0, segment=segment).collect()
    assert sorted((int(x.file[-5]), *x[1:]) for x in read) == sorted(want)
    assert tokencounts.document_lengths(blocks.limit(0), end=0).collect() == []


def test_documents(spark):
    texts = ["", None, "a <|endoftext|> b", "word " * 30000, "x", "x", "é" * 99]
    docs = spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts)], "doc_id long, text string, first int").repartition(3)
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    got = {x.doc_id: x.n_tokens for x in tokencounts.count_tokens(docs, block_tokens=64).collect()}
    assert got == {n: len(library.encode(t or "", add_special_tokens=False).ids) for n, t in enumerate(texts)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None), (None, "")], "doc_id long, text string")
    got = tokencounts.count_tokens(docs, block_tokens=4).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (0, 1), (1, 2), (1, 2), (2, 0)]
    assert tokencounts.count_tokens(docs.limit(0)).collect() == []
