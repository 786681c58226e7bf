import hashlib

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tabveil.llm.bpe import Bpe, encode_decode

TEXTS = ["", "a", "aa" * 3000, "x<|endoftext|>y <|endoftext|><|endoftext|>", "\x1c\x1d a\x85b 　 c\xa0\xa0d  \n\n e\t\tf", "don't I'll WE'RE 12345 ½²", "日本語テスト 🎉🎉", "a\x00b\r\n  \r\n", "!!!! ??? 'x 's", "z" * 9000, "tail ", " head", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def test_ids_and_text_as_the_library(spark, library):
    rows = [(n, t, "x") for n, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in encode_decode(docs).collect()}
    dig = {r.doc_id: r for r in encode_decode(docs, digests=True).collect()}
    for n, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[n].ids) == ids
        assert got[n].decoded == library.decode(ids, skip_special_tokens=False) == (t or "")
        assert dig[n].n_tokens == len(ids)
        assert dig[n].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert encode_decode(docs.limit(0)).collect() == []


def test_one_and_many_trees_agree():
    b = Bpe(open(path("byte_bpe_50k.json")).read())
    pieces = [" thtionansh", "ononon", "é", "a", "ththththth", "zzzz"] * 3
    for p, ids in b.learn([p + str(n) for n, p in enumerate(pieces)]).items():
        assert ids == b.merge_one(p.encode())


def test_long_texts_are_not_remembered(library):
    """One unbroken piece of 200,000 letters, and long texts with runs of spaces."""
    b = Bpe(open(path("byte_bpe_50k.json")).read())
    texts = ["".join("abcdefgh"[i * i % 97 % 8] for i in range(200_000)), "some  words with  spaces " * 5000, "short text"]
    assert [list(x) for x in b.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(len(k) for c in (b.cache, b.runs) for k in c if isinstance(k, str)) <= 64


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Bpe(open(path("word_bpe_49k.json")).read())
