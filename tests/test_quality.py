import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import calendar as cal, judgment as jd, quality as q
from barloom.plans import operations as ops
from barloom.sources.tables import empty_table

DAYS = [dt.date(2026, 7, 13) + dt.timedelta(days=i) for i in range(3)]
BAR = "security_id int, trade_date date, close double, adj_factor double, pre_close double, up_limit double, down_limit double, is_suspended int, is_st int, volume bigint"


def tables(spark, n=20, spike=False, drop=0):
    data = []
    for s in range(1, n + 1):
        for i, d in enumerate(DAYS):
            if i == 2 and s <= drop:
                continue
            close = 10.0 * (1.5 if spike and s == 1 and i == 2 else 1.0)
            data.append((s, d, close, 1.0, 10.0, 11.0, 9.0, 0, 0, 100))
    bars = spark.createDataFrame(data, BAR)
    master = spark.createDataFrame([(s, f"{600000 + s}.SH", "n", "main", dt.date(2020, 1, 1)) for s in range(1, n + 1)],
                                   "security_id int, exchange_code string, name string, board string, list_date date").withColumn("delist_date", F.lit(None).cast("date"))
    calendar = cal.build(spark.createDataFrame([(d, 1) for d in DAYS], "cal_date date, is_open int"))
    return q.Tables(bars, master, calendar, empty_table(spark, "fin_statement"), empty_table(spark, "factor_value"))


def passed(df):
    return {r["trade_date"]: r["passed"] for r in df.collect()}


def test_row_count_rule(spark):
    assert passed(q.row_count(tables(spark), min_universe=10)) == dict.fromkeys(DAYS, True)
    assert passed(q.row_count(tables(spark), min_universe=30)) == dict.fromkeys(DAYS, False)
    assert passed(q.row_count(tables(spark, drop=2), min_universe=10))[DAYS[2]] is False
    # Without a large enough previous day the share of listed securities decides.
    assert passed(q.row_count(tables(spark, drop=2), min_universe=1))[DAYS[0]] is True


def test_adjusted_move_rule(spark):
    assert passed(q.adj_continuity(tables(spark, spike=True))) == {DAYS[0]: True, DAYS[1]: True, DAYS[2]: False}
    t = tables(spark, spike=True)
    fresh = q.Tables(t.bars, t.master.withColumn("list_date", F.lit(DAYS[2])), t.calendar, t.statements, t.factors)
    assert passed(q.adj_continuity(fresh))[DAYS[2]] is True


def test_limit_rule_and_sample(spark):
    t = tables(spark)
    assert all(passed(q.limit_prices(t)).values())
    bent = q.Tables(t.bars.withColumn("up_limit", F.lit(11.02)), t.master, t.calendar, t.statements, t.factors)
    assert not any(passed(q.limit_prices(bent, sample=None)).values())
    picked = [sorted(r["security_id"] for r in q.limit_mismatches(t, sample=5).collect()) for _ in range(2)]
    assert picked[0] == picked[1] and len(picked[0]) == 15


def test_all_rules_and_the_gate(spark):
    results = q.run_all(tables(spark, spike=True), row_count={"min_universe": 10})
    assert {r["rule"] for r in results.collect()} == set(q.registered())
    assert {r["trade_date"]: r["blocked"] for r in q.blocked_days(results).collect()} == {DAYS[0]: False, DAYS[1]: False, DAYS[2]: True}


def test_own_rules_can_be_registered(spark):
    @q.rule("always_soft", q.SOFT)
    def fail(t):
        return q.bar_counts(t.bars).select("trade_date", F.lit(False).alias("passed"), F.lit("x").alias("message"))

    try:
        results = q.run_all(tables(spark), row_count={"min_universe": 10})
        assert results.where("rule = 'always_soft' and not passed").count() == 3
        assert not any(r["blocked"] for r in q.blocked_days(results).collect())
    finally:
        q._RULES.pop("always_soft")
    with pytest.raises(ValueError):
        q.rule("x", "medium")


def test_cross_source(spark):
    a = spark.createDataFrame([("A", DAYS[0], 10.0, 100), ("B", DAYS[0], 10.0, 100)], "exchange_code string, trade_date date, close double, volume bigint")
    b = spark.createDataFrame([("A", DAYS[0], 10.05, 100), ("C", DAYS[0], 10.0, 100)], "exchange_code string, trade_date date, close double, volume bigint")
    got = {r["exchange_code"]: (r["side"], r["differs"]) for r in q.source_differences(a, b).collect()}
    assert got == {"A": ("both", False), "B": ("first_only", True), "C": ("second_only", True)}


def test_backfill_skips_published_and_blocks_failures(spark):
    t = tables(spark, spike=True)
    versions = spark.createDataFrame([("daily_bar", DAYS[0].isoformat(), 20)], "dataset string, version string, row_count bigint")
    days = spark.createDataFrame([(d,) for d in DAYS], "trade_date date")
    out = ops.backfill(t.bars, t, versions, days, row_count={"min_universe": 10})
    assert [r["version"] for r in out.published.collect()] == [DAYS[1].isoformat()]
    assert {r["trade_date"] for r in out.rows.select("trade_date").distinct().collect()} == set(DAYS[1:])
    assert ops.backfill(t.bars, t, versions, days, gate=False).published.count() == 2


def test_tradability_statuses(spark):
    t = tables(spark, n=4)
    bars = t.bars.withColumn("is_suspended", ((F.col("security_id") == 1) & (F.col("trade_date") == F.lit(DAYS[2]))).cast("int")).withColumn(
        "close", F.when((F.col("security_id") == 2) & (F.col("trade_date") == F.lit(DAYS[2])), 11.0).otherwise(F.col("close"))).withColumn(
        "is_st", ((F.col("security_id") == 3) & (F.col("trade_date") == F.lit(DAYS[0]))).cast("int"))
    sus = spark.createDataFrame([], "security_id int, suspend_date date")
    got = {r["security_id"]: r for r in jd.tradability(bars, sus, t.statements, DAYS[2]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "blocked", 2: "caution", 3: "caution", 4: "ok"}
    assert (got[2]["n_limit_up"], got[1]["n_suspended"], got[4]["finance_ann_lag_days"]) == (1, 1, None)
    assert [(e["trade_date"], e["events"]) for e in got[2]["events"]] == [(DAYS[2], ["limit_up"])]


def test_percentile_is_share_at_or_below(spark):
    fac = spark.createDataFrame([(DAYS[0], i, "f", x) for i, x in enumerate([1.0, 2.0, 2.0, 3.0])], "trade_date date, security_id int, factor_name string, value double")
    got = {r["security_id"]: r["pct"] for r in jd.market_percentiles(fac).collect()}
    assert got == {0: 0.25, 1: 0.75, 2: 0.75, 3: 1.0}
    members = spark.createDataFrame([("I", 0, DAYS[0], DAYS[2]), ("I", 3, DAYS[0], DAYS[2])], "index_code string, security_id int, in_date date, out_date date")
    inside = {r["security_id"]: r["pct"] for r in jd.index_percentiles(fac, members, "I").collect()}
    assert inside == {0: 0.5, 1: 0.5, 2: 0.5, 3: 1.0}
