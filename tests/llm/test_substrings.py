import hashlib
import random

import pytest

from tabveil.llm import substrings
from tabveil.llm.substrings import remove_repeated


def brute(rows, width):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("many", [4096, 1])
def test_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY_SPANS", many)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 3000)
    r = random.Random(6)
    make = lambda n: "".join(r.choice("abcdefgé hijk") for _ in range(n))
    shared = [make(n) for n in (99, 100, 101, 180, 400)]
    rows = []
    for i in range(90):
        t = make(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            t += s[r.randint(0, 40) :] + make(r.randint(0, 60))
        rows.append((i, t))
    rows += [(200, rows[5][1]), (201, rows[5][1][:-1]), (202, None), (203, ""), (204, "a" * 700), (205, "ab" * 300 + "c"), (206, "xyz" * 200), (207, "x" + "xyz" * 100)]
    rows += [(300 + i, make(40) + shared[3] + make(40)) for i in range(40)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, start int")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeated(docs, digests=True).collect()}
    assert got == brute(rows, 100)


def test_repeated_rows_null_ids_and_empty(spark):
    t = "".join(chr(97 + i * 7 % 26) for i in range(60)) + "".join(chr(97 + i * i % 26) for i in range(90))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t + "!"), (2, "q")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, bytes(x.kept)) for x in remove_repeated(docs).collect())
    assert got == [(0, (t + "!").encode()), (1, b""), (1, b""), (2, b"q")]
    assert remove_repeated(docs.limit(0)).collect() == []
