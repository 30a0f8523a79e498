import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import coverage as cv, factors as fct, indicators as ta, prices as pr

START = dt.date(2025, 1, 1)


def bars(spark, closes, sid=1, adj=1.0):
    data = [(sid, START + dt.timedelta(days=i), float(c), adj) for i, c in enumerate(closes)]
    return spark.createDataFrame(data, "security_id int, trade_date date, close double, adj_factor double")


def values(df, name):
    return [r[name] for r in df.orderBy("trade_date").collect()]


def test_momentum(spark):
    got = values(fct.price_factors(bars(spark, range(100, 125)), ["mom_20"]), "mom_20")
    assert got[:20] == [None] * 20
    assert got[24] == pytest.approx(124 / 104 - 1)


def test_volatility(spark):
    closes = [100.0]
    for i in range(29):
        closes.append(closes[-1] * (1.01 if i % 2 else 0.99))
    got = values(fct.price_factors(bars(spark, closes), ["vol_20"]), "vol_20")
    rets = np.diff(closes) / np.array(closes[:-1])
    assert got[-1] == pytest.approx(np.std(rets[-20:], ddof=1)) and got[-1] > 0
    assert got[19] is None and got[20] is not None


def test_turnover_allows_gaps(spark):
    rates = [1.0] * 25
    rates[5] = None
    df = spark.createDataFrame([(1, START + dt.timedelta(days=i), x) for i, x in enumerate(rates)], "security_id int, trade_date date, turnover_rate double")
    got = values(fct.turnover_factors(df, ["turn_20"]), "turn_20")
    assert got[-1] == 1.0 and got[5] is None and got[13] is None and got[15] == 1.0


def test_turnover_against_a_walk(spark):
    rnd = random.Random(2)
    days, d = [], START
    for _ in range(120):
        d += dt.timedelta(days=rnd.choice([1, 1, 2, 9, 20]))
        days.append(d)
    rates = [None if rnd.random() < 0.15 else float(rnd.randint(1, 64)) for _ in days]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(days, rates)], "security_id int, trade_date date, turnover_rate double")
    got = values(fct.turnover_factors(df, ["turn_20"]), "turn_20")
    for i, day in enumerate(days):
        window = [r for a, r in zip(days[:i + 1], rates[:i + 1]) if a >= day - dt.timedelta(days=70)][-20:]
        present = [x for x in window if x is not None]
        want = sum(present) / len(present) if rates[i] is not None and len(present) >= 15 else None
        assert got[i] == pytest.approx(want)


def test_value_factors(spark):
    basic = spark.createDataFrame([(1, START, 10_000.0), (2, START, 20_000.0), (3, START, -1.0), (4, START, float("nan"))], "security_id int, trade_date date, total_mv double")
    st = spark.createDataFrame([(1, 1e7, 5e7), (2, 5e7, 1e8), (3, 1.0, 1.0)], "security_id int, p double, e double").select(
        "security_id", F.lit(START).alias("ann_date"), F.lit(START).alias("report_date"), F.lit("income").alias("stmt_type"),
        F.lit(0).alias("update_flag"), F.create_map(F.lit("net_profit"), "p", F.lit("equity"), "e").alias("fields"))
    got = {r["security_id"]: (r["ep"], r["bp"]) for r in fct.value_factors(basic, st, ["ep", "bp"]).collect()}
    assert got == {1: pytest.approx((0.1, 0.5)), 2: pytest.approx((0.25, 0.5))}


def test_lookback_bound_and_zero_price(spark):
    days = [START + dt.timedelta(days=10 * i) for i in range(25)]
    df = spark.createDataFrame([(1, d, 10.0, 1.0) for d in days], "security_id int, trade_date date, close double, adj_factor double")
    assert set(values(fct.price_factors(df, ["mom_20"]), "mom_20")) == {None}
    assert values(fct.price_factors(df, ["mom_20"], bound=400), "mom_20")[-1] == 0.0
    zero = bars(spark, [0.0] + [1.0] * 24)
    assert values(fct.price_factors(zero, ["mom_20"]), "mom_20")[20] is None


def test_full_range_equals_day_by_day(spark):
    rnd = random.Random(9)
    frames = [bars(spark, [100 * np.exp(sum(rnd.gauss(0, 0.02) for _ in range(i % 5 + 1))) for i in range(90)], sid, 1.0 + sid / 10) for sid in (1, 2)]
    px = frames[0].unionByName(frames[1])
    basic = px.select("security_id", "trade_date", F.lit(100.0).alias("total_mv"), (F.col("close") / 64).alias("turnover_rate"))
    st = spark.createDataFrame([], "security_id int, ann_date date, report_date date, stmt_type string, update_flag int, fields map<string,double>")
    full = {(r["trade_date"], r["security_id"], r["factor_name"]): r["value"] for r in fct.compute(px, basic, st, parity_bound=True).collect()}
    for day in (START + dt.timedelta(days=i) for i in (19, 20, 45, 89)):
        one = fct.compute(px, basic, st, parity_bound=True, start=day, end=day).collect()
        assert {(r["trade_date"], r["security_id"], r["factor_name"]): r["value"] for r in one} == {k: x for k, x in full.items() if k[0] == day}


def test_unknown_factor(spark):
    with pytest.raises(ValueError):
        fct.compute(bars(spark, [1, 2]), None, None, names=["nope"])


def test_adjustment_modes(spark):
    df = spark.createDataFrame([(1, START, 10.0, 1.0), (1, START + dt.timedelta(days=1), 6.0, 2.0)], "security_id int, trade_date date, close double, adj_factor double")
    assert values(pr.adjusted(df, "post"), "close") == [10.0, 12.0]
    assert values(pr.adjusted(df, "pre"), "close") == [5.0, 6.0]
    assert values(pr.adjusted(df, "none"), "close") == [10.0, 6.0]
    with pytest.raises(ValueError):
        pr.adjusted(df, "sideways")
    zero = df.withColumn("adj_factor", F.lit(0.0))
    assert values(pr.adjusted(zero, "pre"), "close") == [None, None]


def test_index_return_leaves_gaps_out(spark):
    days = [START + dt.timedelta(days=i) for i in range(3)]
    data = [(1, days[0], 10.0), (1, days[1], 11.0), (1, days[2], 12.1), (2, days[0], 10.0), (2, days[2], 20.0)]
    df = spark.createDataFrame(data, "security_id int, trade_date date, close double").withColumn("adj_factor", F.lit(1.0))
    members = spark.createDataFrame([("I", 1, days[0], dt.date(2099, 12, 31)), ("I", 2, days[0], dt.date(2099, 12, 31))],
                                    "index_code string, security_id int, in_date date, out_date date")
    calendar = spark.createDataFrame([(d, 1, days[max(i - 1, 0)], days[min(i + 1, 2)]) for i, d in enumerate(days)], "cal_date date, is_open int, prev_open date, next_open date")
    strict = {r["trade_date"]: r["ret"] for r in pr.member_equal_returns(df, members, calendar).collect()}
    assert strict == {days[1]: pytest.approx(0.1), days[2]: pytest.approx(0.1)}
    filled = {r["trade_date"]: r["ret"] for r in pr.member_equal_returns_filled(df, members).collect()}
    assert filled[days[2]] == pytest.approx((0.1 + 1.0) / 2)


def walk(n, seed=4):
    rnd = np.random.default_rng(seed)
    close = 10 + rnd.normal(0, 0.3, n).cumsum()
    return pd.DataFrame({
        "security_id": 1, "trade_date": [START + dt.timedelta(days=i) for i in range(n)], "open": close, "high": close + 0.5,
        "low": close - 0.5, "close": close, "volume": np.arange(n) + 100,
    })


SCHEMA = "security_id int, trade_date date, open double, high double, low double, close double, volume bigint"


def test_sma_small(spark):
    pdf = walk(5).assign(close=[1.0, 2, 3, 4, 5])
    df = spark.createDataFrame(pdf, SCHEMA)
    assert values(df.select("trade_date", ta.sma("close", 3).alias("x")), "x") == [None, None, 2.0, 3.0, 4.0]


def test_recursive_indicators_by_hand(spark):
    """EMA, MACD and KDJ from their recurrences on 60 rows, including the null heads."""
    pdf = walk(60)
    got = ta.compute(spark.createDataFrame(pdf, SCHEMA)).orderBy("trade_date").collect()
    c, hi, lo = pdf["close"].tolist(), pdf["high"].tolist(), pdf["low"].tolist()
    e12 = e26 = c[0]
    dea = k = d = None
    for i in range(60):
        if i:
            e12, e26 = e12 + (c[i] - e12) * 2 / 13, e26 + (c[i] - e26) * 2 / 27
        low9, high9 = min(lo[max(0, i - 8):i + 1]), max(hi[max(0, i - 8):i + 1])
        rsv = (c[i] - low9) / (high9 - low9) * 100 if i >= 8 else 50.0
        k = rsv if k is None else k + (rsv - k) / 3
        d = k if d is None else d + (k - d) / 3
        r = got[i]
        assert (r["k"], r["d"], r["j"]) == pytest.approx((k, d, 3 * k - 2 * d))
        if i < 25:
            assert r["dif"] is None and r["dea"] is None
            continue
        dif = e12 - e26
        dea = dif if dea is None else dea + (dif - dea) * 0.2
        assert r["dif"] == pytest.approx(dif)
        if i < 33:
            assert r["dea"] is None and r["macd_hist"] is None
        else:
            assert (r["dea"], r["macd_hist"]) == pytest.approx((dea, 2 * (dif - dea)))


def test_bands_and_payload(spark):
    pdf = walk(30)
    out = ta.compute(spark.createDataFrame(pdf, SCHEMA))
    got = out.orderBy("trade_date").collect()
    last = pdf["close"].iloc[-20:]
    assert got[-1]["boll_upper"] == pytest.approx(last.mean() + 2 * last.std(ddof=0)) and got[18]["boll_mid"] is None
    assert not any(isinstance(x, float) and np.isnan(x) for r in got for x in r)
    bar = ta.payload(out).orderBy("trade_date").first()["bar"]
    assert bar.startswith('{"trade_date":"2025-01-01","open":') and '"ma5":null' in bar and '"volume":100' in bar
    assert ta.payload_head(out).first()["count"] == 30


def test_flat_prices_give_neutral_stochastics(spark):
    pdf = walk(12).assign(close=5.0, high=5.0, low=5.0)
    assert set(values(ta.compute(spark.createDataFrame(pdf, SCHEMA)), "k")) == {50.0}


def test_distribution_and_histogram(spark):
    fac = spark.createDataFrame([(START, i, "f", float(i)) for i in range(61)] + [(START, 99, "f", float("nan"))],
                                "trade_date date, security_id int, factor_name string, value double")
    px = spark.createDataFrame([(START, i) for i in range(100)], "trade_date date, security_id int")
    r = cv.distribution(fac, px).first()
    assert (r["n_valid"], r["p50"], r["p1"], r["universe"]) == (61, 30.0, pytest.approx(0.6), 100)
    bins = {b["bin"]: b["n"] for b in cv.histogram(fac, ["factor_name"]).collect()}
    assert sum(bins.values()) == 61 and max(bins) == 29 and bins[29] == 3
    same = cv.histogram(fac.withColumn("value", F.lit(1.0)), ["factor_name"]).collect()
    assert [(b["bin"], b["n"]) for b in same] == [(0, 62)]


def test_coverage_alerts(spark):
    px = spark.createDataFrame([(START, i, 0) for i in range(9)] + [(START, 9, 1)], "trade_date date, security_id int, is_suspended int")
    fac = spark.createDataFrame([(START, i, "ep", 1.0) for i in range(8)], "trade_date date, security_id int, factor_name string, value double")
    covered = cv.coverage(fac, px, ["ep", "bp"])
    got = {r["factor_name"]: r["coverage"] for r in covered.collect()}
    assert got == {"ep": pytest.approx(8 / 9), "bp": 0.0}
    alerts = sorted((r["factor_name"], r["level"]) for r in cv.alerts(covered, 0.9).collect())
    assert alerts == [("bp", "error"), ("bp", "warn"), ("ep", "warn")]
    assert cv.report(covered, 0.9).first()["n_alerts"] == 3
    assert cv.report(cv.coverage(fac, px, ["ep"]), 0.5).first()["passed"]


def test_histogram_rows_stay_where_they_are(spark):
    """The edges go to the rows: counting starts where the rows lie, and only counts are dealt by factor."""
    from barloom.operators import coverage

    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, "a").alias("factor_name"), F.col("id").cast("double").alias("value"))
    df = df.repartition(3).localCheckpoint()
    out = coverage.histogram(df, ["factor_name"], bins=10)
    with_hint = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in with_hint
    assert out.agg(F.sum("n")).head()[0] == 1000
    assert [r["n"] for r in out.where("factor_name is null").collect()] == [10] * 10
