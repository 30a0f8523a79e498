"""Affine scans against the recurrence row by row, whatever the chunks."""

import datetime as dt
import random

import pytest

from barloom.operators import indicators as ta, scan

START = dt.date(2020, 1, 1)


def recurrence(values, alpha):
    out, y, n = [], None, 0
    for x in values:
        if x is not None:
            y, n = (x if y is None else (1 - alpha) * y + alpha * x), n + 1
        out.append((y, n))
    return out


def series(seed, n, holes=0.0, gap=3):
    r, day, out = random.Random(seed), START, []
    for _ in range(n):
        out.append((day, None if r.random() < holes else 100 + r.gauss(0, 20), r.choice([None, -1.5, 0.0, 7.25])))
        day += dt.timedelta(days=r.randint(1, gap))
    return out


@pytest.mark.parametrize("days", [366, 40, 7, 1])
def test_scan_equals_the_recurrence(spark, monkeypatch, days):
    monkeypatch.setattr(scan, "DAYS", days)
    all_of = {0: series(0, 400), 1: series(1, 150, holes=0.3), 2: series(2, 3), 3: [(START, None, None)], 4: series(4, 60, gap=200), 5: [(START + dt.timedelta(days=i), None if i < 20 else float(i), 1.0) for i in range(50)]}
    df = spark.createDataFrame([(k, *x) for k, v in all_of.items() for x in v], "security_id int, trade_date date, p double, q double")
    steps = [scan.Step("a", "p", 2 / 13), scan.Step("b", "q", 1 / 3), scan.Step("c", "p", 2 / 200)]
    got = {(r["security_id"], r["trade_date"]): r for r in scan.smoothed(df, steps, key=["security_id"], seen=True).collect()}
    assert len(got) == sum(map(len, all_of.values()))
    for key, rows in all_of.items():
        for s, column in zip(steps, (1, 2, 1)):
            for row, (y, n) in zip(rows, recurrence([x[column] for x in rows], s.alpha)):
                r = got[key, row[0]]
                assert r[f"__seen_{s.name}"] == n and r[s.name] == (None if y is None else pytest.approx(y, rel=1e-12, abs=1e-12))


def test_one_long_series_in_many_chunks(spark):
    """40 years of one security: its chunks lie in several tasks."""
    rows = series(9, 10_000, gap=2)
    df = spark.createDataFrame([(1, *x) for x in rows], "security_id int, trade_date date, p double, q double").repartition(4, "trade_date")
    out = scan.smoothed(df, [scan.Step("a", "p", 2 / 27)], key=["security_id"])
    got = {r["trade_date"]: r["a"] for r in out.collect()}
    want = recurrence([x[1] for x in rows], 2 / 27)
    assert out.select("__chunk").distinct().count() > 35
    assert all(got[row[0]] == pytest.approx(y, rel=1e-12) for row, (y, _) in zip(rows, want))


def test_no_python_in_the_indicator_plan(spark):
    df = spark.createDataFrame([], "security_id int, trade_date date, open double, high double, low double, close double, volume bigint")
    out = ta.compute(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan and out.count() == 0
