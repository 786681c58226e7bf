import os
import random
import re
import time

import numpy as np
import pytest

from tabveil.llm import jaccard
from tabveil.llm.components import connected_components
from tabveil.llm.jaccard import similar_documents


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("centres", [32, 1])
def test_against_brute_force(spark, monkeypatch, centres):
    monkeypatch.setattr(jaccard, "CENTRES", centres)
    r = random.Random(4 + centres)
    word = lambda: r.choice(["the", "Of", "and", "x1", "y2", "zed", "q", "longer", "é"]) + str(r.randint(0, 30))
    shared = [word() for _ in range(30)]
    rows = []
    for g in range(25):
        base = [word() for _ in range(r.randint(1, 70))]
        for _ in range(r.randint(1, 9)):
            x = list(base)
            for _ in range(r.randint(0, 5)):
                x[r.randrange(len(x))] = word()
            rows.append((len(rows) * 3, " ".join(x if r.random() < 0.7 else x + shared)))
    rows += [(1, "A b"), (4, "a  B\n"), (7, ""), (10, None), (13, " \t"), (16, "a b"), (19, "the " * 4000), (22, "the the the the the"), (4, "a b")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, n string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in similar_documents(docs).collect())
    assert got == brute(rows)
    assert similar_documents(docs.limit(0)).collect() == []


def test_members_of_one_prefix(spark):
    """Sets of equal size whose first shingles are equal, and null ids."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(8):
        x = list(words)
        for i in range(k):
            x[59 - i] = f"only{k}x{i}"
        rows.append((k, " ".join(x)))
    rows += [(20, "a b c d e f g"), (None, "a b c d e f g"), (None, "nothing like it")]
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(None if d == 99 else d, n, None if c == 99 else c) for d, n, c in brute([(99 if d is None else d, t) for d, t in rows])}
    assert got == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(5, 5), (7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 60)}}


def families():
    """Two of five texts, alike within each; the k-th ones of both share a rare passage and nothing else."""
    base = [" ".join(f"{f}{i}" for i in range(91)) for f in "ab"]
    return [(5 * f + k, base[f] + " " + " ".join(f"rare{k}x{i}" for i in range(9))) for f in range(2) for k in range(5)]


def watch(monkeypatch, after):
    real = jaccard.materialise

    def seen(df, name, **how):
        out = real(df, name, **how)
        after(name, out)
        return out

    monkeypatch.setattr(jaccard, "materialise", seen)


def test_pairs_that_share_too_little_of_their_prefixes_are_left_before_sets_are_moved(spark, monkeypatch):
    rows, pairs = families(), []
    watch(monkeypatch, lambda name, out: pairs.extend((x.a // 5, x.b // 5) for x in out.collect()) if name == "star-pairs" else None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # so that rid is the row's number
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in similar_documents(docs).collect())
    assert got == brute(rows) and {c for _, _, c in got} == {0, 5}
    assert set(pairs) == {(0, 0), (1, 1)}, pairs


def test_bound_of_two_prefixes():
    """What is common up to the end of the first prefix and the smaller rest are never less than all that is common."""
    r = np.random.default_rng(3)
    levels = r.integers(0, 6, 4000).astype(np.uint8)
    order = np.lexsort((np.arange(4000), levels))
    tight = 0
    for k in range(2000):
        pool = np.arange(4000) if k % 2 else np.arange(150)
        x = r.choice(pool, r.integers(1, 120), replace=False)
        y = np.unique(np.append(r.choice(x, r.integers(0, len(x) + 1), replace=False), r.choice(pool, r.integers(1, 30), replace=False)))
        x, y = (order[np.sort(np.argsort(order)[s])].astype(np.uint64) for s in (x, y))
        p, q = (s[: int(jaccard.prefix_sizes(np.array(len(s))))] for s in (x, y))
        i, j = jaccard.known_upto(p, q, levels[p.astype(int)], levels[q.astype(int)])
        bound, common = len(np.intersect1d(p, q)) + min(len(x) - i, len(y) - j), len(np.intersect1d(x, y))
        assert common <= bound
        tight += common == bound
    assert tight > 10


def test_disk_is_given_back_as_tables_are_written(spark, monkeypatch):
    """Shuffle files go with each table, not when the driver's JVM happens to collect garbage, and tables go after their last use."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    blocks = lambda: {b for b in manager.diskBlockManager().getAllBlocks().mkString("|").split("|") if b.startswith("shuffle_")}
    known, left, paths = blocks(), {}, {}

    def after(name, out):
        time.sleep(1)  # they are deleted beside what comes next
        left[name] = blocks() - known
        paths[name] = out._tabveil_path

    watch(monkeypatch, after)
    docs = spark.createDataFrame(families(), "doc_id long, text string").repartition(3)
    assert similar_documents(docs).count() == 10
    for name in ("sets", "variants", "groups", "members", "met-tokens"):
        assert not left[name], (name, left[name])
    there = {name for name, path in paths.items() if os.path.exists(path.removeprefix("file://"))}
    assert there & {"sets", "members"} and not there & {"variants", "groups", "met-tokens", "star-groups", "wanted-sets", "mixed-tokens"}, there


@pytest.mark.parametrize("few", [0, 10**6])
def test_pairs_left_after_the_centres_with_and_without_a_look_at_prefixes(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    test_against_brute_force(spark, monkeypatch, 1)
