"""Overlap join of interval tables against comparing every pair."""

import datetime as dt
import random

import pytest

from barloom.operators import asof, scd2

START, FAR = dt.date(2020, 1, 1), dt.date(2099, 12, 31)


def day(n):
    return START + dt.timedelta(days=n)


def table(seed, n, name):
    r, out = random.Random(seed), []
    for i in range(n):
        a = r.randrange(-300, 900)
        b = r.choice([a, a + 1, a + r.randrange(40), a + r.randrange(2000)])
        out.append((r.choice(["x", "y", None]), f"{name}{i}", day(a), FAR if r.random() < 0.1 else day(b)))
    return out + [("x", f"{name}null", None, day(5)), ("x", f"{name}back", day(9), day(4))]


def brute(left, right, keyed):
    out = []
    for k, l, a, b in left:
        for k2, r, c, d in right:
            if None in (a, b, c, d) or a >= b or c >= d or (keyed and (k is None or k != k2)):
                continue
            if max(a, c) < min(b, d):
                out.append((l, r, max(a, c), min(b, d)))
    return sorted(out)


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("bin_days", [1, 7, 64, 10_000])
def test_every_pair_once(spark, keyed, bin_days):
    left, right = table(1, 60, "l"), table(2, 50, "r")
    a = spark.createDataFrame(left, "k string, l string, in_date date, out_date date")
    b = spark.createDataFrame(right, "k string, r string, in_date date, out_date date")
    out = asof.overlaps(a, b, on=["k"] if keyed else None, columns=["r"], bin_days=bin_days)
    assert sorted((x["l"], x["r"], x["in_date"], x["out_date"]) for x in out.collect()) == brute(left, right, keyed)


def test_the_plan_holds_no_range_join(spark):
    a = spark.createDataFrame(table(1, 5, "l"), "k string, l string, in_date date, out_date date")
    b = spark.createDataFrame(table(2, 5, "r"), "k string, r string, in_date date, out_date date")
    plan = asof.overlaps(a, b, columns=["r"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides(spark):
    a = spark.createDataFrame(table(1, 5, "l"), "k string, l string, in_date date, out_date date")
    b = spark.createDataFrame([], "k string, r string, in_date date, out_date date")
    assert asof.overlaps(a, b, columns=["r"]).count() == 0
    assert asof.overlaps(b, a, on=["k"], columns=["l"]).count() == 0


def test_runs_of_days(spark):
    rows = [("a", day(i)) for i in (0, 1, 2, 2, 5, 7, 8)] + [("b", day(3)), ("b", None)]
    out = scd2.spans_of_days(spark.createDataFrame(rows, "k string, d date"), ["k"], "d").collect()
    assert sorted((r["k"], r["in_date"], r["out_date"]) for r in out) == [("a", day(0), day(3)), ("a", day(5), day(6)), ("a", day(7), day(9)), ("b", day(3), day(4))]
