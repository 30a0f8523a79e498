import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import trading as tr
from barloom.operators import calendar as cal, orders as od, performance as pf, weights as wt
from barloom.plans import research as rs

D = dt.date(2026, 7, 13)
DAYS = [D + dt.timedelta(days=i) for i in range(4)]


def panel(spark, data=(("A", 0.1, "x"), ("B", 0.5, "x"), ("C", 0.3, "y"))):
    return spark.createDataFrame([(D, c, v, i) for c, v, i in data], "trade_date date, exchange_code string, value double, industry string")


def by_code(df):
    return {r["exchange_code"]: r["weight"] for r in df.collect()}


def test_top_two_equal(spark):
    assert by_code(wt.target_weights(panel(spark), "equal", 2)) == {"B": 0.5, "C": 0.5}


@pytest.mark.parametrize("top_n", [None, 3])
def test_rank_weights(spark, top_n):
    got = by_code(wt.target_weights(panel(spark), "factor_rank", top_n))
    assert got == pytest.approx({"A": 1 / 6, "B": 3 / 6, "C": 2 / 6})


@pytest.mark.parametrize("top_n", [None, 10])
def test_industry_neutral(spark, top_n):
    got = by_code(wt.target_weights(panel(spark), "industry_neutral", top_n))
    assert got["A"] + got["B"] == pytest.approx(0.5) and got["C"] == pytest.approx(0.5) and got["B"] > got["A"]


@pytest.mark.parametrize("top_n", [None, 10])
def test_ties_share_their_ranks_and_sums_are_one(spark, top_n):
    df = panel(spark, [("A", 1.0, "x"), ("B", 1.0, "x"), ("C", 2.0, None), ("D", None, "x")])
    out = wt.target_weights(df, ["equal", "factor_rank", "industry_neutral"], top_n)
    sums = {r["weight_method"]: r["s"] for r in out.groupBy("weight_method").agg(F.sum("weight").alias("s")).collect()}
    assert sums == pytest.approx({"equal": 1.0, "factor_rank": 1.0, "industry_neutral": 1.0})
    ranks = by_code(out.where("weight_method = 'factor_rank'"))
    assert ranks == pytest.approx({"A": 1.5 / 6, "B": 1.5 / 6, "C": 3 / 6})


def test_weight_errors(spark):
    with pytest.raises(ValueError):
        wt.target_weights(panel(spark), "nope")
    with pytest.raises(ValueError):
        wt.target_weights(panel(spark).drop("industry"), "industry_neutral")


def test_normalised(spark):
    df = spark.createDataFrame([(D, "A", 0.5), (D, "B", 1.5), (D, "C", -1.0), (D, "E", None)], "trade_date date, exchange_code string, weight double")
    assert by_code(wt.normalized(df, ["trade_date"])) == pytest.approx({"A": 0.25, "B": 0.75})
    with pytest.raises(Exception, match="weights do not sum to 1"):
        wt.normalized(df, ["trade_date"], renormalize=False).collect()


def test_exposure_with_an_industry_missing_on_each_side(spark):
    sig = spark.createDataFrame([(D, "x", 0.7), (D, None, 0.3)], "trade_date date, industry string, weight double")
    idx = spark.createDataFrame([(D, "x"), (D, "y"), (D, "y"), (D, "y")], "trade_date date, industry string")
    got = {r["industry"]: (r["signal_weight"], r["index_weight"], r["diff"]) for r in wt.exposure(sig, idx).collect()}
    assert got == {"x": pytest.approx((0.7, 0.25, 0.45)), "UNKNOWN": pytest.approx((0.3, 0.0, 0.3)), "y": pytest.approx((0.0, 0.75, -0.75))}


NAV = [100.0, 102.0, 101.0, 99.0, 103.0, 104.0]


def curve(spark, with_ret):
    rets = [0.0] + [b / a - 1 for a, b in zip(NAV, NAV[1:])]
    df = spark.createDataFrame([("r", D + dt.timedelta(days=i), x, r) for i, (x, r) in enumerate(zip(NAV, rets))], "run string, trade_date date, nav double, ret double")
    return df if with_ret else df.drop("ret")


@pytest.mark.parametrize("with_ret", [True, False])
def test_metrics_by_hand(spark, with_ret):
    r = pf.metrics(curve(spark, with_ret), ["run"]).first()
    rets = ([0.0] if with_ret else []) + [b / a - 1 for a, b in zip(NAV, NAV[1:])]
    ann = 1.04 ** (242 / len(rets)) - 1
    vol = np.std(rets, ddof=1) * math.sqrt(242)
    assert r["total_return"] == pytest.approx(0.04) and r["ann_return"] == pytest.approx(ann) and r["ann_vol"] == pytest.approx(vol)
    assert r["sharpe"] == pytest.approx(ann / vol) and r["max_drawdown"] == pytest.approx(99 / 102 - 1)
    assert r["calmar"] == pytest.approx(ann / abs(99 / 102 - 1)) and r["hit_ratio"] == pytest.approx(3 / len(rets)) and r["turnover"] is None


def test_excess_metrics(spark):
    bench = spark.createDataFrame([(D + dt.timedelta(days=i), 0.01) for i in range(1, 4)], "trade_date date, ret double")
    r = pf.excess_metrics(curve(spark, False), bench, ["run"]).first()
    er = np.array([b / a - 1 for a, b in zip(NAV, NAV[1:])][:3]) - 0.01
    assert r["excess_total"] == pytest.approx(np.prod(1 + er) - 1) and r["info_ratio"] == pytest.approx(er.mean() * 242 / (er.std(ddof=1) * math.sqrt(242)))
    assert pf.excess_metrics(curve(spark, False), bench.limit(1), ["run"]).count() == 0


def test_portfolio_series_by_hand(spark):
    """Two names, one of them not buyable on its day; the last day's weights are dropped, the last holding is held to the end."""
    calendar = cal.build(spark.createDataFrame([(d, 1) for d in DAYS], "cal_date date, is_open int"))
    weights = spark.createDataFrame([("r", DAYS[0], 1, 0.6), ("r", DAYS[0], 2, 0.4), ("r", DAYS[1], 1, 1.0), ("r", DAYS[3], 2, 1.0)],
                                    "run string, trade_date date, security_id int, weight double")
    returns = spark.createDataFrame([(s, d, 0.01 * s * (i + 1)) for s in (1, 2) for i, d in enumerate(DAYS)], "security_id int, trade_date date, ret double")
    execution = spark.createDataFrame([(s, d, 10.0, 10.0, 11.0, 9.0, s == 2) for s in (1, 2) for d in DAYS],
                                      "security_id int, trade_date date, open double, close double, up_limit double, down_limit double, suspended boolean")
    out = pf.portfolio_series(weights, returns, execution, calendar, by=["run"], costs=tr.NO_COSTS).orderBy("trade_date").collect()
    assert [(r["trade_date"], round(r["gross"], 6), round(r["turnover"], 6), round(r["cash_ratio"], 6), r["n_positions"], r["n_fills"], r["n_rejects"]) for r in out] == [
        (DAYS[1], 0.0, 0.6, 0.4, 1, 1, 1), (DAYS[2], 0.018, 0.4, 0.0, 1, 1, 0), (DAYS[3], 0.04, 0.0, 0.0, 1, 0, 0)]
    assert out[-1]["nav"] == pytest.approx(1.018 * 1.04)
    late = pf.portfolio_series(weights, returns, execution, calendar, by=["run"], costs=tr.NO_COSTS, last_day=DAYS[2]).collect()
    assert len(late) == 2
    costly = pf.portfolio_series(weights, returns, execution, calendar, by=["run"]).orderBy("trade_date").first()
    assert costly["cost"] == pytest.approx(0.6 * 0.0008)


def test_entry_day_and_names_without_a_bar(spark):
    """Close 10, next open 20, close 20: nothing is earned before the purchase. A name without a bar stays held at return 0."""
    calendar = cal.build(spark.createDataFrame([(d, 1) for d in DAYS], "cal_date date, is_open int"))
    weights = spark.createDataFrame([("r", DAYS[0], 1, 0.5), ("r", DAYS[0], 2, 0.5)], "run string, trade_date date, security_id int, weight double")
    prices = [(1, DAYS[0], 10.0, 10.0), (1, DAYS[1], 20.0, 20.0), (1, DAYS[3], 20.0, 22.0), (2, DAYS[0], 5.0, 5.0), (2, DAYS[1], 5.0, 6.0)]
    execution = spark.createDataFrame([(s, d, o, c, 0.0, 0.0, False, c) for s, d, o, c in prices],
                                      "security_id int, trade_date date, open double, close double, up_limit double, down_limit double, suspended boolean, mark double")
    returns = spark.createDataFrame([(1, DAYS[1], 1.0), (1, DAYS[3], 0.1), (2, DAYS[1], 0.2)], "security_id int, trade_date date, ret double")
    args = weights, returns, execution, calendar
    out = pf.portfolio_series(*args, by=["run"], costs=tr.NO_COSTS).orderBy("trade_date").collect()
    assert [(round(r["gross"], 9), r["n_positions"], r["cash_ratio"]) for r in out] == [(0.1, 2, 0.0), (0.0, 2, 0.0), (0.05, 2, 0.0)]
    at_close = pf.portfolio_series(*args, by=["run"], costs=tr.NO_COSTS, mode="next_close").orderBy("trade_date").first()
    assert at_close["gross"] == 0.0


def test_unsold_names_are_rejects(spark):
    calendar = cal.build(spark.createDataFrame([(d, 1) for d in DAYS], "cal_date date, is_open int"))
    weights = spark.createDataFrame([("r", DAYS[0], 1, 1.0), ("r", DAYS[1], 2, 1.0)], "run string, trade_date date, security_id int, weight double")
    execution = spark.createDataFrame([(s, d, 10.0, 10.0, 11.0, 9.0, s == 1 and d == DAYS[2]) for s in (1, 2) for d in DAYS],
                                      "security_id int, trade_date date, open double, close double, up_limit double, down_limit double, suspended boolean")
    returns = spark.createDataFrame([], "security_id int, trade_date date, ret double")
    series = pf.portfolio_series(weights, returns, execution, calendar, by=["run"])
    assert [r["n_rejects"] for r in series.orderBy("trade_date").collect()] == [0, 1, 0]
    figures = pf.metrics(series, ["run"]).first()
    assert (figures["n_fills"], figures["n_rejects"]) == (3, 1)


def test_net_value_after_a_total_loss(spark):
    rows = [("r", D + dt.timedelta(days=i), x) for i, x in enumerate((0.1, -1.0, -1.2, 0.05))]
    nav = pf.with_nav(spark.createDataFrame(rows, "run string, trade_date date, ret double"), ["run"]).orderBy("trade_date").collect()
    assert [round(r["nav"], 9) for r in nav] == [1.1, 0.0, 0.0, 0.0]


def test_no_look_ahead(spark):
    """Changing a later day's data does not change earlier days of the series."""
    calendar = cal.build(spark.createDataFrame([(d, 1) for d in DAYS], "cal_date date, is_open int"))
    weights = spark.createDataFrame([("r", d, 1, 1.0) for d in DAYS], "run string, trade_date date, security_id int, weight double")
    execution = spark.createDataFrame([(1, d, 10.0, 10.0, 11.0, 9.0, False) for d in DAYS],
                                      "security_id int, trade_date date, open double, close double, up_limit double, down_limit double, suspended boolean")
    base = spark.createDataFrame([(1, d, 0.01) for d in DAYS], "security_id int, trade_date date, ret double")
    bent = base.withColumn("ret", F.when(F.col("trade_date") == F.lit(DAYS[3]), 0.9).otherwise(F.col("ret")))
    a, b = (pf.portfolio_series(weights, x, execution, calendar, by=["run"]).where(F.col("trade_date") < F.lit(DAYS[3])).orderBy("trade_date").collect() for x in (base, bent))
    assert a == b


def test_same_run_twice(spark):
    def run():
        return pf.metrics(curve(spark, True), ["run"]).first()
    assert run() == run()


def test_order_difference(spark):
    have = spark.createDataFrame([("A", 100), ("B", 500)], "exchange_code string, quantity int")
    want = spark.createDataFrame([("A", 300), ("C", 200)], "exchange_code string, target int")
    got = {r["exchange_code"]: (r["side"], r["quantity"]) for r in od.difference(have, want).collect()}
    assert got == {"A": ("buy", 200), "B": ("sell", 500), "C": ("buy", 200)}


def screened(spark, orders, quotes, positions=(("600000.SH", 100, 1000.0),), **kw):
    o = spark.createDataFrame(orders, "exchange_code string, side string, quantity int, limit_price double")
    q = spark.createDataFrame(quotes, "exchange_code string, price double, volume double, pre_close double, is_suspended int, is_st int")
    p = spark.createDataFrame(list(positions), "exchange_code string, quantity int, market_value double")
    return {(r["exchange_code"], r["side"], r["quantity"]): (r["ok"], r["reasons"], r["adjusted_qty"]) for r in od.screen(o, q, p, **kw).collect()}


def test_order_screen(spark):
    quotes = [("600000.SH", 10.0, 1e6, 9.9, 0, 0), ("600001.SH", 11.0, 1e6, 10.0, 0, 0), ("600002.SH", 9.0, 1e6, 10.0, 0, 0),
              ("600003.SH", 10.0, 1e6, 10.0, 1, 0), ("688001.SH", 10.0, 1e6, 10.0, 0, 0)]
    orders = [("600000.SH", "buy", 100, None), ("600000.SH", "buy", 250, None), ("600000.SH", "sell", 200, None), ("600000.SH", "hold", 100, None),
              ("600000.SH", "buy", 0, None), ("600001.SH", "buy", 100, None), ("600002.SH", "sell", 100, None), ("600003.SH", "buy", 100, None),
              ("688001.SH", "buy", 199, None), ("688001.SH", "buy", 201, None), ("600009.SH", "buy", 100, None), ("600009.SH", "buy", 200, 5.0),
              ("000000.XX", "buy", 100, None), ("600000.SH", "buy", 90000, None)]
    got = screened(spark, orders, quotes, cash=100_000.0)
    assert got[("600000.SH", "buy", 100)] == (True, [], None)
    assert got[("600000.SH", "buy", 250)] == (True, ["lot_adjusted"], 200)
    reasons = {k: v[1][-1] for k, v in got.items() if not v[0]}
    assert reasons == {
        ("600000.SH", "sell", 200): "holding", ("600000.SH", "hold", 100): "bad_side", ("600000.SH", "buy", 0): "bad_quantity",
        ("600001.SH", "buy", 100): "limit_up", ("600002.SH", "sell", 100): "limit_down", ("600003.SH", "buy", 100): "suspended",
        ("688001.SH", "buy", 199): "below_min_lot", ("600009.SH", "buy", 100): "no_price", ("000000.XX", "buy", 100): "unknown_code",
        ("600000.SH", "buy", 90000): "cash"}
    assert got[("688001.SH", "buy", 201)][0] and got[("600009.SH", "buy", 200)][0]


def test_order_caps_and_costs(spark):
    quotes = [("600000.SH", 10.0, 1e6, 9.9, 0, 0)]
    order = [("600000.SH", "buy", 100, None)]
    assert screened(spark, order, quotes, cash=1000.0)[("600000.SH", "buy", 100)][0]
    assert screened(spark, order, quotes, cash=1000.0, costs=tr.Costs())[("600000.SH", "buy", 100)][1] == ["cash"]
    assert screened(spark, order, quotes, cash=1e6, limits=od.Limits(max_order_value=900.0))[("600000.SH", "buy", 100)][1] == ["order_value"]
    assert screened(spark, order, quotes, cash=1e6, limits=od.Limits(max_position_value=1500.0))[("600000.SH", "buy", 100)][1] == ["position_value"]


def test_session_mark_and_history(spark):
    sessions = spark.createDataFrame([("s", 40_000.0, 100_000.0, 100_000.0), ("empty", 5.0, 5.0, None)], "session_id string, cash double, initial_cash double, rebalance_total double")
    positions = spark.createDataFrame([("s", "A", 5000, 50_000.0), ("s", "B", 100, 900.0), ("s", "Z", 10, 1.0)], "session_id string, exchange_code string, quantity int, cost double")
    closes = spark.createDataFrame([("A", 13.6), ("B", 10.0)], "exchange_code string, price double")
    got = {r["session_id"]: r for r in od.mark_sessions(sessions, positions, closes, D).collect()}
    s = got["s"]
    assert (s["market_value"], s["total_asset"], s["pnl_vs_initial"], s["n_missing_quotes"]) == (69_000.0, 109_000.0, 9_000.0, 1)
    assert (got["empty"]["total_asset"], got["empty"]["pnl_vs_rebalance"], got["empty"]["n_positions"]) == (5.0, 0.0, 0)
    marks = spark.createDataFrame([("s", DAYS[0], 107_000.0), ("s", DAYS[1], 109_000.0)], "session_id string, mark_date date, total_asset double")
    prev = od.with_previous_mark(marks).orderBy("mark_date").collect()
    assert [r["pnl_vs_prev_mark"] for r in prev] == [None, 2_000.0]


def test_names_are_filled(spark):
    master = spark.createDataFrame([("A", "old", DAYS[0]), ("A", "new", DAYS[1]), ("B", "bee", DAYS[0])], "exchange_code string, name string, valid_from date")
    pos = spark.createDataFrame([("a", None), ("B", "B"), ("C", " "), ("D", "kept")], "exchange_code string, name string")
    assert {r["exchange_code"]: r["name"] for r in od.named(pos, master).collect()} == {"A": "new", "B": "bee", "C": "—", "D": "kept"}


def test_best_cell(spark):
    cells = spark.createDataFrame([("mom_20", "equal", 0.5, "ok"), ("ep", "industry_neutral", 1.2, "ok"), ("bp", "equal", 9.9, "fail"), ("x", "equal", None, "ok")],
                                  "factor string, weight_method string, sharpe double, status string")
    best = rs.best_cell(cells).first()
    assert (best["factor"], best["weight_method"], best["sharpe"]) == ("ep", "industry_neutral", 1.2)
    with pytest.raises(ValueError):
        rs.best_cell(cells, "alpha")


def test_version_clamp_and_filters():
    assert rs.clamp(DAYS[3], DAYS[1].isoformat()) == DAYS[1]
    assert rs.clamp(DAYS[3], "unpublished") == DAYS[3]
    with pytest.raises(ValueError):
        rs.check_filters(["st", "blue"])
