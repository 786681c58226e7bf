"""Singling-out predicates against plain counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.operators import singling as S


def plain(rows, atoms):
    def meets(row, column, op, num, txt):
        v = row[column]
        if op == "null":
            return v is None
        want = num if column.startswith("n") else txt
        return v is not None and (v <= want if op == "<=" else v >= want if op == ">=" else v == want)

    return sum(all(meets(r, *a) for a in atoms) for r in rows)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(6)
    return [{"id": i, "n1": None if i % 17 == 0 else float(r.integers(0, 40)), "n2": float(np.round(r.normal(), 2)), "t1": None if i == 5 else "abc|"[i % 4], "t2": str(r.integers(0, 90))} for i in range(400)]


SCHEMA = "id long, n1 double, n2 double, t1 string, t2 string"


def test_all_predicates_are_counted_in_one_scan(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "PREDICATES", 120)
    r = np.random.default_rng(7)
    def atom():
        c = ["n1", "n2", "t1", "t2"][r.integers(0, 4)]
        like = rows[r.integers(0, len(rows))][c]
        if like is None:
            return (c, "null", None, None)
        return (c, ["<=", ">=", "="][r.integers(0, 3)], float(like), None) if c.startswith("n") else (c, "=", None, like)
    asked = {f"p{i}": [atom() for _ in range(r.integers(1, 4))] for i in range(300)} | {"none": [], "strange": [("t1", "=", None, "not there")]}
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA).repartition(3)
    predicates = spark.createDataFrame(list(asked.items()), f"pid string, atoms array<{S.ATOM}>")
    got = {x.pid: x.n for x in S.count_matches(df, predicates, ["n1", "n2"], ["t1", "t2"]).collect()}
    assert got == {p: n for p, a in asked.items() if a and (n := plain(rows, a))}


def test_predicates_that_met_two_rows_are_looked_for_no_more(spark, monkeypatch):
    """The rows after the first ones hold values that only a predicate still looked for would stumble over."""
    df = spark.createDataFrame([(i, float(i % 2), float(i), "a", str(i)) for i in range(50)], SCHEMA).coalesce(1)
    asked = {"many": [("n1", "<=", 1.0, None)], "two": [("n2", ">=", 48.0, None)], "one": [("n2", ">=", 49.0, None), ("t1", "=", None, "a")], "no": [("n2", ">=", 50.0, None)], "last": [("t2", "=", None, "49")]}
    predicates = spark.createDataFrame(list(asked.items()), f"pid string, atoms array<{S.ATOM}>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for rows_at_once in (1, 20):
            monkeypatch.setattr(S, "ROWS_AT_ONCE", rows_at_once)
            got = {x.pid: x.n for x in S.count_matches(df, predicates, ["n1", "n2"], ["t1", "t2"], most=2).collect()}
            assert got == {"many": 5, "two": 2, "one": 1, "last": 1}  # after the first batch of five, many is left alone
            assert {x.pid: x.n for x in S.count_matches(df, predicates, ["n1", "n2"], ["t1", "t2"]).collect()} == got | {"many": 50}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_univariate_guesses(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, "a", None), (2, 1.0, 6.0, "a", "x"), (3, 2.0, 6.0, "b", "x"), (4, 3.0, float("nan"), "a", "y")], SCHEMA)
    got = {tuple(r.atoms[0]) for r in S.univariate(df, ["n1", "n2"], ["t1", "t2"], 50).collect()}
    assert got == {("n1", "=", 2.0, None), ("n1", "=", 3.0, None), ("n1", ">=", 3.0, None), ("n2", "=", 5.0, None), ("n2", "<=", 5.0, None), ("n2", "null", None, None), ("t1", "=", None, "b"), ("t2", "null", None, None), ("t2", "=", None, "y")}
    assert S.univariate(df, ["n1", "n2"], ["t1", "t2"], 4).count() == 4


def test_attacks_pick_out_one_row(spark, rows):
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    half = lambda n: df.where(F.col("id") % 3 == n)
    got = {r.n_columns: r for r in S.singling_out_risks(half(0), half(1), df, ["n1", "n2"], ["t1", "t2"], (1, 2, 8), 60, 300).collect()}
    assert set(got) == {1, 2, 4}  # eight columns are more than there are
    assert all(r.attacks <= 60 and r.guesses == 60 for r in got.values()) and got[2].attacks > 20
    # of predicates that one row of all meets, those of that third's rows pick out one there
    assert all(r.success + r.control <= r.attacks for r in got.values()) and got[4].success > 0
    copy = {r.n_columns: r for r in S.singling_out_risks(df, half(1), df, ["n1", "n2"], ["t1", "t2"], (1, 4), 60, 300).collect()}
    assert all(r.success == r.attacks for r in copy.values())
    none = S.singling_out_risks(df, df, df.limit(0), ["n1", "n2"], ["t1", "t2"], (1, 2), 60, 300).collect()
    assert [(r.attacks, r.guesses) for r in none] == [(0, 0), (0, 0)]
