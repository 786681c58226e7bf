import random

from tabveil.llm.linededup import drop_repeated_lines


def brute(rows, least):
    """Every run of at least `least` characters that an earlier place begins with too."""
    lines = {i: (t.split("\n") if t is not None else []) for i, t in rows}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        x = lines[i]
        for s in range(len(x)):
            fresh = []
            for e in range(s + 1, len(x) + 1):
                run = tuple(x[s:e])
                if run in seen and sum(map(len, run)) >= least:
                    gone[i].update(range(s, e))
                fresh.append(run)
            seen.update(fresh)
    return {i: ("\n".join(v for n, v in enumerate(lines[i]) if n not in gone[i]) if t is not None else None, len(lines[i]), len(gone[i])) for i, t in rows}


def test_against_brute_force(spark):
    r = random.Random(5)
    alphabet = ["", "a", "bb", "ccc", "dddd", "e" * 9, "f" * 14]
    rows = [(i, "\n".join(r.choice(alphabet) for _ in range(r.randint(1, 24)))) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + "\nzz"), (202, None), (203, ""), (204, "\n" * 40), (205, "a\n" * 900)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, pos string")
    for least in (1, 12):
        got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in drop_repeated_lines(docs, min_chars=least, report=True).collect()}
        assert got == brute(rows, least)


def test_repeated_rows_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc\nx"), (1, "abc\nx"), (None, "abc\ny"), (2, "q")], "doc_id long, text string")
    got = sorted(x.text for x in drop_repeated_lines(docs, min_chars=3).collect())
    assert got == ["abc\ny", "q", "x", "x"]
    assert drop_repeated_lines(docs.limit(0), min_chars=3).collect() == []


def test_a_text_of_many_lines(spark):
    """50,000 lines, of which a run comes twice; a text of which the run is repeated; null ids."""
    run = [f"repeated line {n} with enough characters" for n in range(20)]
    lines = [f"line {n}" for n in range(50_000)]
    long = "\n".join([*lines[:100], *run, *lines[100:], *run])
    docs = spark.createDataFrame([(1, long), (2, "\n".join(["own", *run])), (None, "x"), (None, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.text is None): r for r in drop_repeated_lines(docs, report=True).collect()}
    assert got[1, False].text == "\n".join([*lines[:100], *run, *lines[100:]]) and got[1, False].n_removed == 20
    assert got[2, False].text == "own" and got[None, False].text == "x" and got[3, False].text == ""


def test_a_text_of_very_many_lines(spark):
    """Work grows with the lines, not with their square; a passage that recurs at the far end goes."""
    import time

    passage = "\n".join(f"a line of the passage that recurs, number {i}" for i in range(5))
    text = "\n".join([passage, *(f"{i} x" for i in range(300_000)), passage])
    began = time.time()
    got = drop_repeated_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), report=True).first()
    assert (got.n_lines, got.n_removed) == (300_010, 5) and got.text == text[: -len(passage) - 1]
    assert time.time() - began < 120
