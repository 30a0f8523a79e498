import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom import rules
from barloom.operators import asof, calendar as cal, scd2
from barloom.plans import build

D1, D2, D3, D4 = (dt.date(2024, m, 1) for m in (1, 2, 3, 4))
OPEN = rules.OPEN_END


def snaps(spark, data):
    return spark.createDataFrame([("I", c, d) for c, d in data], "index_code string, exchange_code string, as_of_date date")


def test_members_leave_and_enter(spark, rows):
    df = snaps(spark, [("600000", D1), ("000001", D1), ("000001", D2), ("000002", D2), ("000001", D3), ("000002", D3)])
    got = rows(scd2.member_intervals(df), "exchange_code", "in_date", "out_date")
    assert got == [("000001", D1, OPEN), ("000002", D2, OPEN), ("600000", D1, D2)]


def test_member_comes_back(spark, rows):
    df = snaps(spark, [("a", D1), ("b", D1), ("b", D2), ("a", D3), ("b", D3)])
    got = rows(scd2.member_intervals(df).where("exchange_code = 'a'"), "in_date", "out_date")
    assert got == [(D1, D2), (D3, OPEN)]
    hinted = df.withColumn("in_date", F.lit(dt.date(2020, 1, 15)))
    first_only = rows(scd2.member_intervals(hinted).where("exchange_code = 'a'"), "in_date", "out_date")
    assert first_only == [(dt.date(2020, 1, 15), D2), (D3, OPEN)]
    every = rows(scd2.member_intervals(hinted, hint_every_entry=True).where("exchange_code = 'a'"), "in_date", "out_date")
    assert every == [(dt.date(2020, 1, 15), OPEN)]


def test_entry_hint(spark, rows):
    df = spark.createDataFrame([("I", "a", dt.date(2020, 1, 15), dt.date(2024, 6, 1))], "index_code string, exchange_code string, in_date date, as_of_date date")
    assert rows(scd2.member_intervals(df), "in_date", "out_date") == [(dt.date(2020, 1, 15), OPEN)]


def test_attribute_change_closes_but_gap_does_not(spark, rows):
    df = spark.createDataFrame([("a", "l1", "X", D1), ("a", "l1", "Y", D2), ("a", "l1", "Y", D4), ("b", "l1", "X", D1), ("b", "l1", "X", D3)],
                               "exchange_code string, level string, industry string, as_of_date date")
    got = rows(scd2.attribute_intervals(df), "exchange_code", "industry", "in_date", "out_date")
    assert got == [("a", "X", D1, D2), ("a", "Y", D2, OPEN), ("b", "X", D1, OPEN)]


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError):
        scd2.member_intervals(spark.createDataFrame([("a",)], "exchange_code string"))


def brute_members(data):
    dates, out, active = sorted({d for _, d in data}), [], {}
    by_date = {d: {c for c, x in data if x == d} for d in dates}
    for d in dates:
        for c in set(active) - by_date[d]:
            out.append((c, active.pop(c), d))
        for c in by_date[d] - set(active):
            active[c] = d
    return sorted(out + [(c, d, OPEN) for c, d in active.items()], key=repr)


def test_members_against_a_day_walk(spark, rows):
    rnd = random.Random(7)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=30 * i) for i in range(12)]
    data = [(f"c{i}", d) for i in range(20) for d in days if rnd.random() < 0.6]
    got = rows(scd2.member_intervals(snaps(spark, data)), "exchange_code", "in_date", "out_date")
    assert got == brute_members(data)


def test_merge_touching(spark, rows):
    df = spark.createDataFrame([("a", D1, D2), ("a", D2, D3), ("a", D4, OPEN), ("b", D1, D3), ("b", D2, D2)], "k string, in_date date, out_date date")
    assert rows(scd2.merge_intervals(df, ["k"])) == [("a", D1, D3), ("a", D4, OPEN), ("b", D1, D3)]


def test_sweep_join_equals_range_join(spark, rows):
    rnd = random.Random(3)
    start = dt.date(2024, 1, 1)
    facts = [(s, start + dt.timedelta(days=d), d) for s in range(5) for d in range(0, 200, 3)]
    spans = []
    for s in range(5):
        d = rnd.randint(0, 20)
        while d < 200:
            length = rnd.randint(1, 40)
            spans.append((s, f"v{d}", start + dt.timedelta(days=d), start + dt.timedelta(days=d + length)))
            d += length + rnd.randint(0, 15)
    f = spark.createDataFrame(facts, "security_id int, trade_date date, x int")
    i = spark.createDataFrame(spans, "security_id int, industry string, in_date date, out_date date")
    got = rows(asof.attach_interval(f, i, ["security_id"], ["industry"]), "security_id", "trade_date", "x", "industry")
    want = sorted(((s, d, x, next((v for k, v, a, b in spans if k == s and a <= d < b), None)) for s, d, x in facts), key=repr)
    assert got == want


def statements(spark, data):
    df = spark.createDataFrame(data, "security_id int, ann_date date, report_date date, value double, update_flag int")
    return df.select("security_id", "ann_date", "report_date", F.lit("income").alias("stmt_type"), "update_flag",
                     F.create_map(F.lit("net_profit"), "value").alias("fields"))


PIT = [(1, dt.date(2025, 4, 20), dt.date(2024, 12, 31), 100.0, 0), (1, dt.date(2025, 6, 10), dt.date(2024, 12, 31), 90.0, 1),
       (1, dt.date(2025, 4, 28), dt.date(2025, 3, 31), 30.0, 0)]


@pytest.mark.parametrize("day,want", [(dt.date(2025, 4, 19), None), (dt.date(2025, 4, 21), 100.0), (dt.date(2025, 5, 1), 30.0), (dt.date(2025, 6, 11), 30.0)])
def test_visible_on_day(spark, day, want):
    got = asof.visible_item(statements(spark, PIT), "net_profit", day).collect()
    assert [r["value"] for r in got] == ([] if want is None else [want])


def test_correction_of_a_report_wins(spark):
    got = asof.visible_item(statements(spark, PIT[:2]), "net_profit", dt.date(2025, 6, 11)).first()
    assert got["value"] == 90.0


def test_visible_for_many_days_equals_day_by_day(spark):
    rnd = random.Random(11)
    base = dt.date(2024, 1, 1)
    data = []
    for s in range(4):
        for k in range(8):
            report = base + dt.timedelta(days=90 * k)
            data.append((s, report + dt.timedelta(days=rnd.randint(10, 150)), report, float(s * 100 + k), 0))
            if rnd.random() < 0.4:
                data.append((s, report + dt.timedelta(days=rnd.randint(100, 300)), report, float(s * 100 + k) + 0.5, 1))
    st = statements(spark, data)
    days = [base + dt.timedelta(days=d) for d in range(0, 900, 45)]
    facts = spark.createDataFrame([(s, d) for s in range(4) for d in days], "security_id int, trade_date date")
    got = {(r["security_id"], r["trade_date"]): r["net_profit"] for r in asof.attach_visible(facts, st, ["net_profit"]).collect()}
    for d in days:
        one = {r["security_id"]: r["value"] for r in asof.visible_item(st, "net_profit", d).collect()}
        for s in range(4):
            assert got[(s, d)] == one.get(s)


def test_active_counts_equal_brute_force(spark):
    spans = [("I", D1, D3), ("I", D2, OPEN), ("J", D1, D2)]
    days = [D1 + dt.timedelta(days=i) for i in range(0, 100, 7)]
    i = spark.createDataFrame(spans, "k string, in_date date, out_date date")
    d = spark.createDataFrame([(x,) for x in days], "trade_date date")
    got = {(r["k"], r["trade_date"]): r["members"] for r in asof.active_counts(i, ["k"], d).collect()}
    want = {(k, x): n for k in "IJ" for x in days if (n := sum(1 for kk, a, b in spans if kk == k and a <= x < b))}
    assert got == want


def test_calendar_edges(spark, rows):
    days = [dt.date(2026, 7, 10) + dt.timedelta(days=i) for i in range(5)]  # Fri .. Tue
    df = spark.createDataFrame([(d, int(d.weekday() < 5)) for d in days], "cal_date date, is_open int")
    built = cal.build(df)
    got = {r["cal_date"]: (r["prev_open"], r["next_open"]) for r in built.collect()}
    assert got[days[0]] == (days[0], days[3])
    assert got[days[1]] == (days[0], days[3])
    assert got[days[4]] == (days[3], days[4])
    assert [r[0] for r in cal.weekdays(spark, days[0], days[4]).collect()] == [days[0], days[3], days[4]]
    assert cal.weekdays(spark, days[1], days[0]).count() == 0


def test_strict_mapping_fails_on_unknown_codes(spark):
    master = spark.createDataFrame([("a", 1)], "exchange_code string, security_id int")
    rows_ = spark.createDataFrame([("a",), ("z",)], "exchange_code string")
    kept, rejected = asof.map_ids(rows_, master)
    assert (kept.count(), rejected.count()) == (1, 1)
    with pytest.raises(Exception, match="unknown security code"):
        asof.map_ids_strict(rows_, master).collect()


def test_master_keeps_ids(spark):
    listing = spark.createDataFrame([("600002.SH", "x"), ("600000.SH", "y"), ("300001.SZ", "z")], "exchange_code string, name string")
    known = spark.createDataFrame([("600000.SH", 7)], "exchange_code string, security_id int")
    got = {r["exchange_code"]: (r["security_id"], r["board"], r["list_date"]) for r in build.security_master(listing, known).collect()}
    assert got == {"600000.SH": (7, "main", rules.DEFAULT_LIST_DATE), "300001.SZ": (8, "gem", rules.DEFAULT_LIST_DATE),
                   "600002.SH": (9, "main", rules.DEFAULT_LIST_DATE)}


def test_past_names_stay_past(spark):
    names = spark.createDataFrame([("a", "ST x", D1), ("a", "x", D2)], "exchange_code string, name string, as_of_date date")
    st = build.st_names(build.master_history(names)).collect()
    assert [(r["in_date"], r["out_date"]) for r in st] == [(D1, D2)]
