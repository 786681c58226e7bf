import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tabveil.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proof(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text, in any order; a Counter-like list of results."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    mine = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in mine[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for at, r in enumerate(mine[x]):
            steps = proof(trees[x], at) + proof(top, n)
            lower = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if lower else leaf(r)
            for place, others in steps:
                now = h([*others[:place], now, *others[place:]])
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(s for _, o in steps for s in o), now, now == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string"


def report(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = merkle.tamper_report(df, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_groups_of_all_sizes_nulls_ties_and_repeated_rows(spark):
    rows = [(1, "s", None, 3, "One"), (2, None, None, None, None), (None, "s", "a", 0, ""), (None, "s", "a", 0, ""), (7, "s", "é", 2, "Ü:9"), (9, "x", "", 1, "A" * 100_000)]
    rows += [(i, "s", "b", i, f"Text {i}") for i in range(9)] + [(i, "s", "c", i, f"t {i}") for i in range(65)] + [(i, "s", "d", 1, "Same") for i in (3, 3, 3, 4)]
    assert report(spark, rows) == brute(rows)


def test_several_rounds_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i * 7 % 1009, "s", "hot" if i % 10 else str(i), i, f"Row {i}") for i in range(700)]
    assert report(spark, rows) == brute(rows)


def test_blocks_of_production_size(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"Row {i}") for i in range(2000)]
    assert report(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, "s", "en", 1, "lone A")]])
def test_empty_and_lone(spark, rows):
    assert report(spark, rows) == brute(rows)


def test_witnesses_grow_as_siblings_are_appended():
    front = merkle.Frontier(2)
    digests = [bytes([i]) * 32 for i in range(20)]
    for n, d in enumerate(digests[:3]):
        front.append(d)
        assert [s for _, s, _ in front.open[0]] == [[x for j, x in enumerate(digests[: n + 1]) if j != i] for i in range(n + 1)]
    for d in digests[3:]:
        front.append(d)
    assert front.witnesses[0] == [(0, b"".join(digests[1:8]))] and front.witnesses[17] == [] and len(front.open[1]) == 2
    root = front.finish()
    for d, w in zip(digests, front.witnesses, strict=True):
        assert merkle.fold(d, b"".join(s for _, s in w), bytes(n for p, s in w for n in (p, len(s) // 32))) == root
    assert merkle.fold(b"x" * 32, b"".join(s for _, s in front.witnesses[0]), b"\0\7\0\2") != root
