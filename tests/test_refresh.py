"""Refreshed factor tables equal a full computation after random late, changed and withdrawn rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import factors as fct, refresh

START = dt.date(2023, 1, 2)
FIELDS = "map<string,double>"


def day(i):
    return START + dt.timedelta(days=i)


def inputs(spark, bars, statements):
    rows = spark.createDataFrame([(s, d, *x) for (s, d), x in bars.items()], "security_id int, trade_date date, close double, adj_factor double, total_mv double, turnover_rate double")
    told = spark.createDataFrame([(s, a, r, "income", u, f) for (s, a, r, u), f in statements.items()], f"security_id int, ann_date date, report_date date, stmt_type string, update_flag int, fields {FIELDS}")
    return refresh.Inputs(rows.select("security_id", "trade_date", "close", "adj_factor"), rows.select("security_id", "trade_date", "total_mv", "turnover_rate"), told)


def made(seed):
    r = random.Random(seed)
    bars, statements = {}, {}
    for s in range(1, 5):
        at = 0
        for _ in range(150):
            at += r.choice([1, 1, 1, 2, 3, 30 if r.random() < 0.05 else 1])
            bars[s, day(at)] = (10 + r.random(), 1.0 + r.randrange(3), 100.0 + r.random(), None if r.random() < 0.1 else r.random())
        for q in range(4):
            statements[s, day(40 + 50 * q), day(30 + 50 * q), 0] = {"net_profit": r.random(), "equity": r.random()}
    return r, bars, statements


@pytest.mark.parametrize("seed", range(4))
def test_refresh_equals_a_full_rebuild(spark, seed):
    r, bars, statements = made(seed)
    old_bars, old_told = dict(bars), dict(statements)
    for k in r.sample(sorted(old_bars), 6):  # late: not there before
        del old_bars[k]
    for k in r.sample(sorted(old_bars), 4):  # corrected
        old_bars[k] = (old_bars[k][0] * 2, *old_bars[k][1:])
    for k in r.sample(sorted(old_bars), 2):
        old_bars[k] = (*old_bars[k][:2], 77.0, 0.5)
    gone = r.choice(sorted(bars))
    old_bars[gone[0], day(900)] = (9.0, 1.0, 50.0, 0.2)  # withdrawn since
    if seed % 2:
        k = r.choice(sorted(old_told))
        old_told[k] = {"net_profit": 5.0}
        del old_told[r.choice([x for x in sorted(old_told) if x != k])]
    before, after = inputs(spark, old_bars, old_told), inputs(spark, bars, statements)
    stored = fct.compute(*before).unionByName(fct.compute(*before, names=["ep"], version="other").where("security_id = 1")).cache()
    want = fct.compute(*after).unionByName(fct.compute(*before, names=["ep"], version="other").where("security_id = 1"))
    got = refresh.refresh(stored, before, after)
    key = lambda df: sorted((r["security_id"], r["trade_date"], r["factor_name"], r["version"], round(r["value"], 9)) for r in df.collect())
    assert key(got.table) == key(want)
    assert 0 < got.fresh.count() < want.count()


def test_nothing_changed_touches_nothing(spark):
    _, bars, statements = made(9)
    same = inputs(spark, bars, statements)
    stored = fct.compute(*same).cache()
    got = refresh.refresh(stored, same, inputs(spark, bars, statements))
    assert got.ranges.count() == 0 and got.fresh.count() == 0 and got.table.count() == stored.count()


def test_ranges_merge(spark):
    days = spark.createDataFrame([(1, day(0)), (1, day(5)), (1, day(30)), (2, day(5))], "security_id int, trade_date date")
    got = sorted(tuple(r) for r in refresh.dirty_ranges(days, 10).select("security_id", "in_date", "out_date").collect())
    assert got == [(1, day(0), day(16)), (1, day(30), day(41)), (2, day(5), day(16))]
    assert refresh.dirty_ranges(days.where(F.lit(False)), 10).count() == 0
