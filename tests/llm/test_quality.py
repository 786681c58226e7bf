import random
import zlib

import numpy as np
from tabveil.llm.quality import classify, fit, fit_all


def texts(n, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 120))]
        if i % 3:
            yield i, ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)) + ".", 1
        else:
            kind = r.randint(0, 3)
            yield i, [" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x + "%%%" for x in w), " ".join(x for x in w[:20] for _ in range(9))][kind], 0


def test_held_out_accuracy_and_cases(spark):
    rows = list(texts(600))
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(9001, None, None), (9002, "", "s"), (9003, "word " * 60000, "s"), (1, rows[1][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(1, None, None), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == 604
    want = {i: q for i, _, q in rows}
    test = [r for r in got if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == want[r.doc_id] for r in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in classify(docs.limit(5), labels.limit(0)).collect()} == {0.7}


def test_weights_against_plain_descent_over_all_pairs():
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) + r.logistic(size=300) > 0).astype(int)
    w, cut = fit(x, y)
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, 3)
    want = np.zeros(3)
    for _ in range(4000):
        want -= 0.5 * (d.T @ (1 / (1 + np.exp(-d @ want)) - 1) / len(d) + 1e-3 * want)
    assert np.abs(w - want).max() < 0.15 * np.abs(want).max()
    assert sum(x @ w > cut) == sum(y)


def test_repeated_ids_are_learned_from_in_a_defined_order(spark, monkeypatch):
    monkeypatch.setattr("tabveil.llm.quality.FIT_ROWS", 150)
    rows = [(i // 7, t, q) for i, t, q in texts(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, q in {i: q for i, _, q in rows}.items()], "doc_id long, quality int")
    one, two = (sorted((r.doc_id, r.score) for r in classify(d, labels).collect()) for d in (docs.repartition(1), docs.repartition(5, "text")))
    assert one == two


def test_all_labelled_rows_and_pairs_are_learned_from(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(400, 3)) * [1, 2, 0.3]
    y = (x @ np.array([2.0, -1.0, 0.5]) + r.logistic(size=400) > 0.5).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(q)) for v, q in zip(x, y, strict=True)], "features array<double>, quality int").repartition(3)
    (w, cut), (want, want_cut) = fit_all(rows, 3), fit(x, y)
    assert np.abs(w - want).max() < 1e-6 and abs(cut - want_cut) < 1e-6
    once = fit_all(rows.unionByName(rows.limit(0)).repartition(5), 3)
    assert np.array_equal(once[0], w) and once[1] == cut
