"""Multisets and the coverage cube against plain counting."""

import datetime as dt
import random
from collections import Counter

from barloom.operators import coverage as cv, publish as pb

START = dt.date(2024, 1, 1)


def rows(seed, n):
    r = random.Random(seed)
    return [(r.choice([1, 2, None]), r.choice(["a", "b", None]), r.randrange(3)) for _ in range(n)]


def test_repeated_rows_count(spark):
    for a, b in ((rows(1, 80), rows(2, 60)), (rows(3, 5), []), ([], [])):
        left, right = (spark.createDataFrame(x, "i int, s string, k int") for x in (a, b))
        got = {(x["i"], x["s"], x["k"], x["side"]): x["n"] for x in pb.reconcile(left, right).collect()}
        x, y = Counter(a), Counter(b)
        assert got == {(*k, "landed"): n for k, n in (x - y).items()} | {(*k, "stored"): n for k, n in (y - x).items()}
        assert {(r["i"], r["s"], r["k"]): r["n"] for r in pb.in_both(left, right).collect()} == dict(x & y)


def test_cube_counts_each_set(spark):
    r = random.Random(4)
    bars = [(s, START + dt.timedelta(days=d)) for s in range(6) for d in range(5)]
    fac = [(s, d, f, 1.0 if r.random() < 0.8 else None) for s, d in bars for f in ("x", "y") if r.random() < 0.7]
    inds = [(s, "sw_l1", "A" if s < 2 else "B", START, START + dt.timedelta(days=3)) for s in range(4)]
    boards = {s: "main" if s % 2 else "gem" for s in range(6)}
    got = cv.cube(
        spark.createDataFrame(fac, "security_id int, trade_date date, factor_name string, value double"), spark.createDataFrame(bars, "security_id int, trade_date date"),
        spark.createDataFrame(list(boards.items()), "security_id int, board string"),
        spark.createDataFrame(inds, "security_id int, level string, industry string, in_date date, out_date date"),
    ).collect()
    industry = lambda s, d: next((i for k, _, i, a, b in inds if k == s and a <= d < b), None)
    want = {}
    for s, d, f, v in fac:
        if v is not None:
            i, b = industry(s, d), boards[s]
            for g, key in ((0, (f, i, b)), (1, (f, i, None)), (2, (f, None, b)), (3, (f, None, None)), (5, (None, i, None)), (7, (None, None, None))):
                want.setdefault((g, key), []).append(s)
    assert {(x["grouping"], (x["factor_name"], x["industry"], x["board"])): (x["n_values"], x["n_securities"]) for x in got} == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert len(got) == len(want)
