import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabveil.llm import mixing
from tabveil.llm.bytesarrays import together, word_hashes, words


def make(n, seed=9):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("etaoins") for _ in range(r.randint(1, 8))) for _ in range(200)]
    return [(i, " ".join(r.choice(vocabulary[: 20 + r.randint(0, 180)]) for _ in range(r.randint(0, 90)))) for i in range(n)]


@pytest.mark.parametrize("frequent", [1 << 18, 5])
def test_base_and_model(spark, monkeypatch, frequent):
    monkeypatch.setattr(mixing, "FREQUENT", frequent)
    rows = make(400) + [(900, None), (901, ""), (902, "New UNSEEN wörds\there"), (903, "ab " * 20000), (1, "twice")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    got = mixing.score_texts(docs).collect()
    assert len(got) == len(rows)
    tokens = {n: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for n, (_, t) in enumerate(rows)}
    held = {n: zlib.crc32(str(d).encode()) % 7 == 2 for n, (d, _) in enumerate(rows)}
    counts = {}
    for n, x in tokens.items():
        for w in x if not held[n] else ():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    want = sorted((d, held[n], len(tokens[n]), sum(w in counts for w in tokens[n]), total, round(sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens[n]), 6)) for n, (d, _) in enumerate(rows))
    assert sorted((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    test = [x for x in got if x.held_out and x.n_tokens > 20]
    if frequent > 5:  # most words are spelled otherwise
        assert sum(x.score for x in test) > 1.05 * sum(x.base_score for x in test)  # nearer to 0, or little farther: each word here is drawn alike
    assert all(x.score < 0 and x.bits_per_byte > 0 for x in got)
    assert mixing.score_texts(docs.limit(0)).collect() == []


def model_of(texts, keep=1 << 18):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    begin, end, _ = words(data, at)
    keys, n = np.unique(word_hashes(data, begin, end), return_counts=True)
    top = np.argsort(-n, kind="stable")[:keep]
    return mixing.Model(keys[top], n[top], np.bincount(mixing.LOWER[data], minlength=256), len(texts), int(n.sum())), data, at


def no_rows():
    return pa.table({"bucket": pa.array([], pa.int64()), "answers": pa.array([], pa.binary())})


def nats(model, data, at, held=None, rows=None, bits=0):
    x = mixing.tokens(data, at, model)
    held = np.zeros(len(at) - 1, bool) if held is None else held
    return mixing.code_lengths(mixing.laid_out(x, data, model, *mixing.predicted(x, held, rows if rows is not None else no_rows(), model, bits)), model)


def test_huffman_paths():
    counts = np.random.default_rng(3).integers(0, 1000, 300)
    first, nodes, bits, odds = mixing.huffman(counts)
    assert abs(sum(2.0 ** -(first[1:] - first[:-1])) - 1) < 1e-9
    assert len({(tuple(nodes[a:b]), tuple(bits[a:b])) for a, b in zip(first[:-1], first[1:])}) == 300
    p = [np.prod([1 / (1 + np.exp(-odds[k] * (1 if v else -1))) for k, v in zip(nodes[a:b], bits[a:b])]) for a, b in zip(first[:-1], first[1:])]
    assert np.allclose(p, (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-4)


def test_probabilities_of_all_next_symbols_add_up_to_one():
    """With what is foretold, the words of the vocabulary, the escape (and all next bytes) and the end."""
    texts = [t for _, t in make(60)]
    model, _, _ = model_of(texts)
    first = int(np.diff(model.first)[: model.bytes].max())
    x = {"first": np.array([0, 5]), "symbol": np.array([1, 2, 1, 2, 1]), "text": np.zeros(5, np.int32), "place": np.arange(5), "context": np.arange(5, dtype=np.uint64) * mixing.SPREAD}

    def cost(symbol):
        s = dict(x, symbol=np.append(x["symbol"], symbol), first=np.array([0, 6]), text=np.zeros(6, np.int32), place=np.arange(6), context=np.append(x["context"], np.uint64(77)))
        return mixing.code_lengths(s, model)[0]

    start = mixing.code_lengths(x, model)[0]
    for symbols in (range(model.bytes), range(model.bytes, model.flags), range(model.flags + 6, model.flags + 8)):
        assert abs(sum(math.exp(start - cost(s)) for s in symbols) - 1) < 1e-3
    assert first <= mixing.TOP


def test_every_decision_of_a_word_is_mixed():
    """A rare word, deep in the tree, whose neighbours the text never has costs less each time, down to its last decision."""
    texts = [" ".join(f"w{i}" for i in range(2000))]
    model, _, _ = model_of(texts)
    counts = np.concatenate([np.ones(2000, np.int64), [0, 1]])
    assert np.array_equal(np.diff(model.first)[: model.bytes], np.diff(mixing.huffman(counts)[0]))
    symbol = np.full(2000, 7, np.int32)
    s = {"symbol": symbol, "text": np.zeros(2000, np.int32), "first": np.array([0, 2000]), "place": np.arange(2000), "context": np.zeros(2000, np.uint64)}
    assert mixing.code_lengths(s, model)[0] < 0.5 * 2000  # five bits that aren't mixed would take 3.5 nats each time


@pytest.mark.parametrize("piece", [1 << 20, 3000])
def test_copies_score_apart_and_alone_the_text_counts(spark, monkeypatch, piece):
    monkeypatch.setattr(mixing, "PIECE", piece)
    rows = [(d, t) for d, t in make(300)]
    held = [d for d in range(1000, 1400) if zlib.crc32(str(d).encode()) % 7 == 2]
    free = [d for d in range(1000, 1400) if zlib.crc32(str(d).encode()) % 7 != 2]
    r = random.Random(1)
    fresh = lambda: " ".join("".join(r.choice("etaoins") for _ in range(r.randint(1, 3))) for _ in range(300))
    once, twice, both = fresh(), fresh(), fresh()
    rows += [(held[0], once), (held[1], twice), (free[0], twice), (free[1], both), (free[2], both), (free[3], fresh())]
    got = {x.doc_id: x for x in mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    bits = lambda d: got[d].bits_per_byte
    assert bits(held[1]) < 0.6 * bits(held[0]) and bits(free[1]) < 0.6 * bits(free[3])  # known from another text
    assert abs(bits(free[3]) / bits(held[0]) - 1) < 0.25  # a training text does not know itself
    assert abs(got[free[1]].score - got[free[2]].score) < 1e-6 * abs(got[free[1]].score)


def foretold(spark, rows, model, bits):
    """The symbols that the corpus foretells to each text, by the library, and by counting all votes of other texts one by one; -1 where none."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = mixing.in_pieces(docs.select(F.col("doc_id").alias("id"), "text", mixing.held_out().alias("held_out")).repartition(3))
    got = {}
    answers = mixing.corpus_answers(pieces, spark.sparkContext.broadcast(model), bits).toArrow()
    for piece in {r.piece for r in pieces.select("piece").distinct().collect()}:
        part = pieces.where(F.col("piece") == piece).orderBy("row").toArrow()
        data = np.frombuffer("".join(part.column("text").to_pylist()).encode(), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in part.column("text").to_pylist()])])
        x = mixing.tokens(data, at, model)
        mine = answers.filter(pa.compute.equal(answers.column("piece"), piece)).select(["bucket", "answers"])
        guess, flag, _ = mixing.predicted(x, np.array(part.column("held_out").to_pylist(), bool), mine, model, bits)
        guess = np.where(flag >= 4, guess, -1)
        for i, d in enumerate(part.column("id").to_pylist()):
            got[d] = guess[x["first"][i] : x["first"][i + 1]].tolist()
    symbols, votes = {}, {}
    for d, t in rows:
        b = t.encode()
        x = mixing.tokens(np.frombuffer(b, np.uint8), np.array([0, len(b)]), model)
        h, symbols[d] = x["hash"].tolist(), x["symbol"].tolist()
        own = {}
        for i in range(3, len(h)):
            own.setdefault(tuple(h[i - 3 : i]), symbols[d][i])
        symbols[d] = (h, symbols[d])
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for c, s in own.items():
                if s != model.escape:
                    votes.setdefault(c, {})[d] = s
    want = {}
    for d, (h, _) in symbols.items():
        want[d] = [-1] * len(h)
        for i in range(3, len(h)):
            others = [s for e, s in votes.get(tuple(h[i - 3 : i]), {}).items() if e != d]
            if others:
                want[d][i] = min(set(others), key=lambda s: (-others.count(s), s))
    return got, want


@pytest.mark.parametrize(("bits", "keep", "gathered"), [(0, 1 << 18, 1 << 22), (3, 60, 50)])
def test_what_the_corpus_foretells_counted_one_by_one(spark, monkeypatch, bits, keep, gathered):
    monkeypatch.setattr(mixing, "GATHERED", gathered)
    monkeypatch.setattr(mixing, "PIECE", 2000)
    rows = [(n, t) for n, (_, t) in enumerate(make(150))]
    rows += [(500 + n, t + " and " + t) for n, t in rows[:60]] + [(700 + n, "sin eta tan " + w) for n, w in enumerate("a b a b c rare1 rare2 a".split() * 3)] + [(800, "")]
    model, _, _ = model_of([t for _, t in rows], keep)
    got, want = foretold(spark, rows, model, bits)
    assert got == want and sum(v >= 0 for w in want.values() for v in w) > 500


@pytest.mark.parametrize("others", [["x", "y"], ["x", "x", "y"], ["x", "y", "z"], ["x"], ["unseen9"], []])
def test_what_a_training_text_is_foretold_does_not_depend_on_what_it_says(spark, others):
    """So that the probabilities of all its continuations can't exceed 1."""
    free = [d for d in range(100) if zlib.crc32(str(d).encode()) % 7 != 2]
    model, _, _ = model_of(["one two three x y z"] * 3)
    seen = set()
    for own in ("x", "y", "z", "unseen9", "unseen8", "one", ""):
        rows = [(free[0], f"one two three {own}"), *[(d, f"one two three {w}") for d, w in zip(free[1:], others)]]
        got, want = foretold(spark, rows, model, 2)
        assert got == want
        seen.add(got[free[0]][3])
    assert len(seen) == 1


def test_a_score_depends_on_the_text_alone():
    texts = [t for _, t in make(60)]
    model, _, _ = model_of(texts, 100)
    one = "some words and more words \u00e9 " * 300
    alone = nats(model, np.frombuffer(one.encode(), np.uint8), np.array([0, len(one.encode())]))[0]
    for before in ("a", "bcd", "another text " * 40, ""):
        parts = [before.encode(), one.encode(), one.encode()]
        got = nats(model, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        assert abs(got[1] - alone) < 1e-5 * alone and abs(got[2] - alone) < 1e-5 * alone


def one_by_one(s, model):
    """Nats of each text, by a loop over its blocks and decisions."""
    out, sigmoid = [], lambda v: 1 / (1 + math.exp(-v))
    for a, b in zip(s["first"][:-1].tolist(), s["first"][1:].tolist()):
        slots = 1 << math.ceil(math.log2(4 * max(b - a, 8)))
        weight, correction, seen, nats = [list(mixing.START) for _ in range(4)], [0.0] * mixing.BUCKETS, {}, 0.0
        blocks = [range(max(0, n // 2), n) if n > 8 else range(8) for n in (8, 16, 32, 64, 128)] + [range(n, n + 128) for n in range(128, b - a, 128)]
        for block in blocks:
            moves, turns, told = {}, {}, []
            for i in block:
                if i >= b - a:
                    continue
                symbol, context = int(s["symbol"][a + i]), int(s["context"][a + i])
                for level, k in enumerate(range(model.first[symbol], model.first[symbol + 1])):
                    node, bit = int(model.nodes[k]), int(model.bits[k])
                    gate = 2 if symbol >= model.flags else 1 if symbol >= model.bytes else 0 if level < 3 else 3
                    h = int(model.spread[node])
                    where = [(0, (h >> 33) % slots), (1, (((h ^ context) * int(mixing.SPREAD)) % 2**64 >> 33) % slots)]
                    odds = float(model.odds[node])
                    x = [odds] + [math.log((seen.get((w, 1), 0) + sigmoid(odds)) / (seen.get((w, 0), 0) + sigmoid(-odds))) - odds for w in where]
                    z = sum(v * w for v, w in zip(x, weight[gate]))
                    bucket = int(min(max(z * 1.5 + mixing.BUCKETS / 2, 0), mixing.BUCKETS - 1))
                    z += correction[bucket]
                    nats += math.log1p(math.exp(-z if bit else z))
                    error = bit - sigmoid(z)
                    for m in range(3):
                        moves[gate, m] = moves.get((gate, m), 0) + error * x[m]
                    turns[bucket] = turns.get(bucket, 0) + error
                    told += [(w, bit) for w in where]
            for (gate, m), v in moves.items():
                weight[gate][m] += min(max(mixing.RATE * v, -0.3), 0.3)
            for bucket, v in turns.items():
                correction[bucket] += min(max(mixing.MAP_RATE * v, -0.3), 0.3)
            for w in told:
                seen[w] = seen.get(w, 0) + 1
        out.append(nats)
    return out


@pytest.mark.parametrize("laid_out", [1 << 16, 50])
def test_code_lengths_one_by_one(monkeypatch, laid_out):
    monkeypatch.setattr(mixing, "LAID_OUT", laid_out)
    texts = [t for _, t in make(30)] + ["", "eta", "rare words aren't symbols " * 30, " ".join(t for _, t in make(12, 4))]
    model, _, _ = model_of(texts[:30], 120)
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x = mixing.tokens(data, at, model)
    s = mixing.laid_out(x, data, model, *mixing.predicted(x, np.zeros(len(texts), bool), no_rows(), model, 0))
    assert len(np.unique(s["symbol"][s["symbol"] >= model.flags])) > 4 and (s["symbol"] < model.escape).any()
    assert np.allclose(mixing.code_lengths(s, model), one_by_one(s, model), rtol=3e-5)


def test_work_for_each_decision(monkeypatch):
    """Of the sums over decisions only those of the last correction, whose buckets lie anyhow, are counted one by one."""
    counted, real = [], np.bincount
    monkeypatch.setattr(mixing.np, "bincount", lambda v, weights=None, minlength=0: (counted.append(len(v) if weights is not None else 0), real(v, weights=weights, minlength=minlength))[1])
    texts = [t for _, t in make(60)]
    model, data, at = model_of(texts)
    x = mixing.tokens(data, at, model)
    s = mixing.laid_out(x, data, model, *mixing.predicted(x, np.zeros(60, bool), no_rows(), model, 0))
    counted.clear()
    mixing.code_lengths(s, model)
    assert sum(counted) <= 1.01 * np.diff(model.first)[s["symbol"]].sum()


def test_hashes_together():
    r = np.random.default_rng(2)
    for keys in (r.integers(0, 1 << 63, 1000).astype(np.uint64), np.repeat(r.integers(0, 1 << 63, 70).astype(np.uint64), 9)[r.permutation(630)],
                 r.integers(0, 50, 300).astype(np.uint64), np.uint64(7 << 60) + r.integers(0, 3, 100).astype(np.uint64), np.full(5, 3, np.uint64), np.array([2**64 - 1, 0], np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)):
        order, begin = together(keys)
        assert np.array_equal(order, np.argsort(keys, kind="stable"))
        assert np.array_equal(keys[order[begin]], np.unique(keys))


def test_votes_that_are_put_together_many_times():
    r = np.random.default_rng(4)
    votes = np.zeros(3000, mixing.VOTE)
    votes["context"], votes["symbol"] = r.integers(0, 40, 3000), r.integers(0, 6, 3000)
    one, parts = mixing.Votes(), mixing.Votes()
    one.add(votes)
    for k in range(0, 3000, 500):
        parts.add(votes[k : k + 500])
        parts.merge()
    for a, b in zip(one.leaders(), parts.leaders(), strict=True):
        assert np.array_equal(a, b)
    for c, best in zip(one.leaders()[0], one.leaders()[1]):
        n = np.bincount(votes["symbol"][votes["context"] == c], minlength=6)
        assert best == (n.max() << 16 | 65535 - int(n.argmax()))


def test_shuffle_files_are_deleted_as_they_end(spark, monkeypatch):
    """Not when the driver's JVM happens to collect garbage: before the texts are scored, no file of the votes is left."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    known = {str(b) for b in manager.diskBlockManager().getAllBlocks().mkString("|").split("|")}
    left, real = {}, mixing.materialise

    def seen(df, name, **how):
        out = real(df, name, **how)
        time.sleep(1)  # they are deleted beside what comes next
        left[name] = {str(b) for b in manager.diskBlockManager().getAllBlocks().mkString("|").split("|")} - known
        return out

    monkeypatch.setattr(mixing, "materialise", seen)
    assert mixing.score_texts(spark.createDataFrame(make(50), "doc_id long, text string").repartition(3)).count() == 50
    assert set(left) == {"pieces", "word-counts", "answers", "scored"}
    for name in ("answers", "scored"):
        assert sum(b.startswith("shuffle_") for b in left[name] - left["word-counts"] - left["pieces"]) <= 4, left  # of small counts at most


def test_online_learning_helps():
    texts = [t for _, t in make(60)]
    model, _, _ = model_of(texts)
    a, b = (" ".join(["eta sin"] * n).encode() for n in (20, 400))
    x, y = (nats(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] / len(t) for t in (a, b))
    assert y < 0.3 * x
