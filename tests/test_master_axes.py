"""Names on two axes (valid, known) and windows in trading days, against plain look-ups."""

import datetime as dt
import random

import pytest

from barloom.operators import calendar as cal
from barloom.plans import build

D = dt.date(2024, 1, 1)


def day(i):
    return D + dt.timedelta(days=i)


def snapshots(seed):
    r, out = random.Random(seed), []
    for code in ("600001.SH", "300002.SZ"):
        for _ in range(25):
            a = r.randrange(60)
            out.append((code, r.choice(["ST A", "A", "B"]), day(a), None if r.random() < 0.2 else day(a + r.randrange(-5, 40))))
    return out


def name_at(rows, code, when, version):
    seen = [(a, k or a, n) for c, n, a, k in rows if c == code and a <= when and (k or a) <= version]
    if not seen:
        return None
    last = max(a for a, _, _ in seen)
    return max((k, n) for a, k, n in seen if a == last)[1]


NAMES = "exchange_code string, name string, as_of_date date, known_on date"


@pytest.mark.parametrize("seed", range(3))
def test_history_at_every_version(spark, seed):
    rows = snapshots(seed)
    names = spark.createDataFrame(rows, NAMES)
    for version in (day(3), day(30), day(70), day(200)):
        spans = build.master_history(names, version).collect()
        for code in ("600001.SH", "300002.SZ"):
            for i in range(0, 110, 7):
                got = [s["name"] for s in spans if s["exchange_code"] == code and s["valid_from"] <= day(i) < s["valid_to"]]
                want = name_at(rows, code, day(i), version)
                assert got == ([want] if want else [])


@pytest.mark.parametrize("seed", range(3))
def test_flags_without_look_ahead(spark, seed):
    rows = snapshots(seed)
    facts = spark.createDataFrame([(c, day(i)) for c in ("600001.SH", "300002.SZ", "none") for i in range(0, 110)], "exchange_code string, trade_date date")
    got = {(r["exchange_code"], r["trade_date"]): r["is_st"] for r in build.st_known_then(facts, spark.createDataFrame(rows, NAMES)).collect()}
    for (code, when), flag in got.items():
        seen = [(a, k or a, n) for c, n, a, k in rows if c == code and a <= when and (k or a) <= when]
        best = max(seen)[:2] if seen else None
        assert flag in ({int("ST" in n) for a, k, n in seen if (a, k) == best} if best else {0})
    assert len(got) == 330


def test_the_master_follows_a_rename(spark):
    listing = spark.createDataFrame([("600001.SH", "now", day(-50)), ("600002.SH", "quiet", day(0))], "exchange_code string, name string, list_date date")
    names = spark.createDataFrame([("600001.SH", "old", day(0), None), ("600001.SH", "ST old", day(10), day(12)), ("600001.SH", "old", day(10), day(30))], NAMES)
    ids = spark.createDataFrame([("600001.SH", 7)], "exchange_code string, security_id int")
    read = lambda version: sorted((r["security_id"], r["name"], r["valid_from"]) for r in build.security_master(listing, ids, names=names, version=version).collect())
    assert read(day(11)) == [(7, "old", day(-50)), (8, "quiet", day(0))]
    assert read(day(20)) == [(7, "ST old", day(10)), (7, "old", day(-50)), (8, "quiet", day(0))]
    assert read(None) == [(7, "old", day(-50)), (8, "quiet", day(0))]


def test_no_limit_window_skips_holidays(spark):
    closed = {2, 3, 4, 5, 6}  # a holiday right after the first day
    calendar = cal.build(spark.createDataFrame([(day(i), int(i not in closed)) for i in range(30)], "cal_date date, is_open int"))
    cases = [("gem", day(1)), ("main", day(1)), ("gem", day(3)), ("other", day(8)), ("gem", None)]
    rows = [(b, start, day(i)) for b, start in cases for i in range(30) if i not in closed]
    df = spark.createDataFrame(rows, "board string, list_date date, trade_date date")
    got = {(r["board"], r["list_date"], r["trade_date"]): r["free"] for r in cal.in_no_limit_trading_days(df, calendar).collect()}
    for board, start in cases:
        open_days = [day(i) for i in range(30) if i not in closed and start and day(i) >= start]
        free = set(open_days[: 5 if board == "gem" else 1])
        assert {d for (b, s, d), x in got.items() if (b, s) == (board, start) and x} == free
    gaps = cal.trading_days_between(df.where("board = 'gem' and list_date is not null"), calendar, "list_date", "trade_date", "n")
    assert {r["n"] for r in gaps.where(f"list_date = '{day(1)}' and trade_date = '{day(7)}'").collect()} == {1}
