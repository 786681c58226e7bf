import random
import re
from itertools import accumulate, combinations

from tabveil.llm.decontam import MASKS, drop_contaminated, overlaps


def brute(docs, items):
    """All alignments with a shared seed whose best stretch is long enough; masks give which alignments count."""
    out = {}
    for d, t in docs:
        x = re.findall(r"[a-z0-9]+", (t or "").lower())
        for i, u in items:
            y = re.findall(r"[a-z0-9]+", (u or "").lower())
            for shift in range(-len(y), len(x)):
                eq = [0 <= k + shift < len(x) and x[k + shift] == y[k] for k in range(len(y))]
                seeded = any(all(eq[k + j] for j, c in enumerate(m) if c == "1") and k + shift >= 0 and k + len(m) + shift <= len(x) for m in MASKS for k in range(len(y) - len(m) + 1))
                if not seeded:
                    continue
                for a in range(len(y)):
                    for b in range(a + 1, len(y) + 1):
                        if eq[a] and eq[b - 1] and a + shift >= 0 and b + shift <= len(x):
                            n, e = b - a, sum(eq[a:b])
                            if e >= 0.8 * n - 1e-9 and n >= max(10, min(13, len(y))):
                                out[d, i] = max(out.get((d, i), (0, 0)), (n, e))
    return {(d, i, *v) for (d, i), v in out.items()}


def test_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.randint(9, 40)))) for i in range(8)]
    items += [(8, ""), (9, None), (10, items[0][1])]
    docs = []
    for d in range(60):
        x = [word() for _ in range(r.randint(0, 60))]
        if d % 2:
            y = items[d % 8][1].split()
            y = y[r.randint(0, 6) :]
            for _ in range(r.randint(0, 6)):
                y[r.randrange(len(y))] = word() if y else ""
            x[3:3] = [y[0].upper() + "!", *y[1:]] if y else []
        docs.append((d, " ".join(x)))
    docs += [(100, None), (101, ""), (102, " ".join([items[1][1]] * 300))]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in overlaps(df, bench).collect()}
    assert got == brute(docs, items[:10]) and len(got) > 15
    kept = {x.doc_id for x in drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {x[0] for x in got}
    assert overlaps(df, bench.limit(0)).collect() == [] and overlaps(df.limit(0), bench).collect() == []


def test_every_pattern_of_substitutions_leaves_a_seed():
    for n in range(10, 26):
        ends = n < 13  # a whole item begins and ends with equal tokens
        for changed in combinations(range(1, n - 1) if ends else range(n), n // 5):
            bits = sum(1 << i for i in changed)
            assert any(not bits & (int(m[::-1], 2) << k) for m in MASKS for k in range(n - len(m) + 1)), (n, changed)


def test_against_brute_force_without_masks(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((10, 11, 12, 13, 15, 20, 25, 40, 60, 200))]
    docs = []
    for _, u in items:
        for phase in range(5):  # every fifth token, and as many at random
            y = u.split()
            docs.append([word() if k % 5 == phase else w for k, w in enumerate(y)])
            for _ in range(2):
                at = set(r.sample(range(len(y)), len(y) // 5))
                docs.append([word() if k in at else w for k, w in enumerate(y)])
    docs = [(d, " ".join([word(), word(), *x, word()])) for d, x in enumerate(docs)]
    want = {}
    for d, t in docs:
        x = t.split()
        for i, u in items:
            y = u.split()
            for shift in range(-len(y), len(x)):
                eq = [0 <= k + shift < len(x) and x[k + shift] == y[k] for k in range(len(y))]
                sums = [0, *accumulate(eq)]
                for a in [k for k, e in enumerate(eq) if e]:
                    for b in [k + 1 for k, e in enumerate(eq) if e and k >= a]:
                        n, e = b - a, sums[b] - sums[a]
                        if n >= min(13, len(y)) and e >= 0.8 * n - 1e-9:
                            want[d, i] = max(want.get((d, i), (0, 0)), (n, e))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_tokens, x.n_equal) for x in overlaps(df, bench).collect()}
    assert got == want and len(want) > 100


def test_long_items(spark):
    """Whole items of 300 to 5,000 tokens within long texts, one with a gap of other words, repeated rows and null ids."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((300, 1500, 3000, 5000))]
    around = lambda t: " ".join([*(word() for _ in range(3000)), t, *(word() for _ in range(50))])
    docs = [(i, around(t)) for i, t in items]
    gap = items[3][1].split()
    gap[1000:1400] = [word() for _ in range(400)]
    docs += [(7, around(" ".join(gap))), (8, "nothing"), (0, docs[0][1]), (0, "other"), (None, docs[1][1])]
    got = sorted(((-1 if x.doc_id is None else x.doc_id), x.item_id, x.n_tokens, x.n_equal) for x in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(-1, 1, 1500, 1500), (0, 0, 300, 300), (1, 1, 1500, 1500), (2, 2, 3000, 3000), (3, 3, 5000, 5000), (7, 3, 5000, 4600)]
