"""Prices, calendar, window functions, intervals and indicators (W, J as-of rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import (
    asof, calendar as cal, factors as fct, indicators as ta, judgment as jd, orders as od,
    performance as pf, prices as pr, ranking, scd2, weights as wt,
)
from barloom.plans import research as rs
from suite.base import query

W = "over (partition by security_id order by trade_date)"


def _last(n):
    return f"over (partition by security_id order by trade_date rows between {n - 1} preceding and current row)"


@query("W01_daily_return", "security_id:i trade_date:d ret:f", "select security_id, trade_date, ret from rets", "rets")
def _(m):
    return pr.daily_returns(m.bars)


_PRICE_COLS = "security_id:i trade_date:d"
_FACTOR_INPUT = ("close", "volume", "adj_factor")  # what factors read of the bars


@query("W02_momentum", _PRICE_COLS + " mom_20:f mom_60:f", "select security_id, trade_date, mom_20, mom_60 from fac_price", "fac_price")
def _(m):
    return fct.price_factors(m.bars, ["mom_20", "mom_60"], bound=190)


@query("W02_momentum_own_bound", _PRICE_COLS + " mom_20:f", """
    select security_id, trade_date, case when lag(trade_date, 20) over w >= trade_date - 70 then px / nullif(lag(px, 20) over w, 0) - 1 end as mom_20
    from rets window w as (partition by security_id order by trade_date)""", "rets")
def _(m):
    return fct.price_factors(m.bars, ["mom_20"])


@query("W02_momentum_wide_bound", _PRICE_COLS + " mom_60:f", """
    select security_id, trade_date, case when lag(trade_date, 60) over w >= trade_date - 400 then px / nullif(lag(px, 60) over w, 0) - 1 end as mom_60
    from rets window w as (partition by security_id order by trade_date)""", "rets")
def _(m):
    return fct.price_factors(m.bars, ["mom_60"], bound=400)


@query("W03_volatility", _PRICE_COLS + " vol_20:f8", "select security_id, trade_date, vol_20 from fac_price", "fac_price")
def _(m):
    return fct.price_factors(m.bars, ["vol_20"], bound=190)


@query("W04_mean_turnover", _PRICE_COLS + " turn_20:f8", "select security_id, trade_date, turn_20 from fac_turn", "fac_turn")
def _(m):
    return fct.turnover_factors(m.basic, ["turn_20"], bound=190)


@query("W05_sma", _PRICE_COLS + " ma5:f4 ma10:f4", f"""
    select security_id, trade_date, case when count(close) {_last(5)} = 5 then avg(close) {_last(5)} end as ma5,
           case when count(close) {_last(10)} = 10 then avg(close) {_last(10)} end as ma10 from bars0""", "bars0")
def _(m):
    return m.raw_bars.select("security_id", "trade_date", ta.sma("close", 5).alias("ma5"), ta.sma("close", 10).alias("ma10"))


# The recursive averages as a recursive query over each security's row numbers.
_RECURSIVE = f"""
    with recursive src as materialized (
      select security_id, trade_date, close, high, low, row_number() {W} as rn,
             coalesce(case when count(close) {_last(9)} = 9 then
               (close - min(low) {_last(9)}) / nullif(max(high) {_last(9)} - min(low) {_last(9)}, 0) * 100 end, 50) as rsv
      from bars0),
    recursive_rows as (
      select security_id, trade_date, rn, close as e12, close as e26, cast(null as double) as dea, rsv as k, rsv as d from src where rn = 1
      union all
      select n.security_id, n.trade_date, n.rn, n.close * (2/13.0::double) + p.e12 * (11/13.0::double), n.close * (2/27.0::double) + p.e26 * (25/27.0::double),
             case when n.rn < 26 then null when n.rn = 26 then
               (n.close * (2/13.0::double) + p.e12 * (11/13.0::double)) - (n.close * (2/27.0::double) + p.e26 * (25/27.0::double))
             else ((n.close * (2/13.0::double) + p.e12 * (11/13.0::double)) - (n.close * (2/27.0::double) + p.e26 * (25/27.0::double))) * 0.2::double + p.dea * 0.8::double end,
             n.rsv * (1/3.0::double) + p.k * (2/3.0::double),
             (n.rsv * (1/3.0::double) + p.k * (2/3.0::double)) * (1/3.0::double) + p.d * (2/3.0::double)
      from recursive_rows p join src n on n.security_id = p.security_id and n.rn = p.rn + 1)
    select r.*, case when rn >= 26 then e12 - e26 end as dif, case when rn >= 34 then dea end as dea9 from recursive_rows r"""


@query("W06_ema", _PRICE_COLS + " ema12:f4", f"select security_id, trade_date, case when rn >= 12 then e12 end as ema12 from ({_RECURSIVE}) z", "bars0")
def _(m):
    return ta.ema(m.raw_bars, 12, name="ema12")


@query("W07_macd", _PRICE_COLS + " dif:f4 dea:f4 macd_hist:f4", f"""
    select security_id, trade_date, dif, dea9 as dea, (dif - dea9) * 2 as macd_hist from ({_RECURSIVE}) z""", "bars0")
def _(m):
    return ta.compute(m.raw_bars)


@query("W08_kdj", _PRICE_COLS + " k:f4 d:f4 j:f4", f"select security_id, trade_date, k, d, 3 * k - 2 * d as j from ({_RECURSIVE}) z", "bars0")
def _(m):
    return ta.compute(m.raw_bars)


@query("W09_bollinger", _PRICE_COLS + " boll_mid:f4 boll_upper:f4 boll_lower:f4", f"""
    select security_id, trade_date, mid as boll_mid, mid + 2 * dev as boll_upper, mid - 2 * dev as boll_lower from (
      select *, case when count(close) {_last(20)} = 20 then avg(close) {_last(20)} end as mid,
             case when count(close) {_last(20)} = 20 then stddev_pop(close) {_last(20)} end as dev from bars0) z""", "bars0")
def _(m):
    return m.raw_bars.select("security_id", "trade_date", *[c.alias(k) for k, c in ta.bollinger().items()])


@query("W10_indicator_table", _PRICE_COLS + " volume:i ma5:f4 ma10:f4 boll_mid:f4 dif:f4 k:f4", f"""
    select b.security_id, b.trade_date, volume, case when rn >= 5 then avg(close) {_last(5)} end as ma5,
           case when rn >= 10 then avg(close) {_last(10)} end as ma10, case when rn >= 20 then avg(close) {_last(20)} end as boll_mid, dif, k
    from bars0 b join ({_RECURSIVE}) z using (security_id, trade_date)""", "bars0")
def _(m):
    return ta.compute(m.stored().raw_bars)


@query("W10_payload_head", "security_id:i n:i start:d last_day:d last_close:f", """
    select security_id, count(*) as n, min(trade_date) as start, max(trade_date) as last_day, arg_max(close, trade_date) as last_close
    from bars0 group by 1""", "bars0")
def _(m):
    return ta.payload_head(m.raw_bars).withColumnsRenamed({"count": "n", "end": "last_day"})


def _pseudo_nav(m):
    """Equal-weight market curve per board, from the bars."""
    rets = pr.daily_returns(m.limited_bars).where("ret is not null")
    daily = rets.groupBy("board", "trade_date").agg(F.avg("ret").alias("ret"))
    return pf.with_nav(daily, ["board"])


_NAV = """(select board, trade_date, ret, case when min(ret) over w <= -1 then 0 else exp(sum(ln(case when ret > -1 then 1 + ret end)) over w) end as nav from (
    select l.board, trade_date, avg(ret) as ret from rets join listing l using (security_id) where ret is not null group by 1, 2) a
    window w as (partition by board order by trade_date))"""


@query("W11_drawdown", "board:s trade_date:d drawdown:f6", f"""
    select board, trade_date, nav / max(nav) over (partition by board order by trade_date) - 1 as drawdown from {_NAV} n""", "rets listing")
def _(m):
    return pf.drawdowns(_pseudo_nav(m), ["board"])


@query("W12_row_drift", "trade_date:d row_count:i prev_count:i drift_pct:f10", """
    select *, (row_count - prev_count) / nullif(prev_count, 0)::double as drift_pct from (
      select *, lag(row_count) over (order by trade_date) as prev_count from (
        select trade_date, count(*) as row_count from bars0 group by 1 order by 1 desc limit 30) a) b""", "bars0")
def _(m):
    from barloom.operators import health

    return health.bar_series(m.raw_bars)


@query("W13_market_percentile", _PRICE_COLS + " factor_name:s pct:f10 n:i", """
    select security_id, trade_date, factor_name, cume_dist() over (partition by trade_date, factor_name order by value) as pct,
           count(*) over (partition by trade_date, factor_name) as n from fac""", "fac")
def _(m):
    return jd.market_percentiles(m.stored_factors())


@query("W13_industry_percentile", _PRICE_COLS + " factor_name:s industry:s pct:f10 n:i", """
    select f.security_id, trade_date, factor_name, i.industry, cume_dist() over (partition by trade_date, factor_name, i.industry order by value) as pct,
           count(*) over (partition by trade_date, factor_name, i.industry) as n
    from fac f join inds i on i.security_id = f.security_id and i.in_date <= trade_date and i.out_date > trade_date""", "fac inds")
def _(m):
    m = m.stored("industries", columns=_FACTOR_INPUT)
    return jd.industry_percentiles(m.stored_factors(), m.industries, "sw_l1")


@query("W13_index_percentile", _PRICE_COLS + " factor_name:s pct:f10 n:i", """
    with v as (select f.*, m.security_id is not null as member from fac f
               left join members m on m.security_id = f.security_id and m.in_date <= trade_date and m.out_date > trade_date)
    select security_id, trade_date, factor_name, count(*) filter (where member) over d as n,
           count(*) filter (where member) over (d order by value) / nullif(count(*) filter (where member) over d, 0)::double as pct
    from v window d as (partition by trade_date, factor_name)""", "fac members")
def _(m):
    m = m.stored("members", columns=_FACTOR_INPUT)
    return jd.index_percentiles(m.stored_factors(), m.members, "IDX_A")


@query("W14_quintile", _PRICE_COLS + " factor_name:s quintile:i", """
    select security_id, trade_date, factor_name, greatest(1, cast(ceil(5 * (rn - 1) / nullif(n - 1, 0)::double) as bigint)) as quintile from (
      select *, row_number() over (partition by trade_date, factor_name order by value, security_id) as rn,
             count(*) over (partition by trade_date, factor_name) as n from fac) z""", "fac")
def _(m):
    ranked = ranking.order_rank(m.stored_factors(), ["trade_date", "factor_name"], ["value", "security_id"], total="n")
    return ranked.withColumn("quintile", ranking.quantile_bucket(5))


@query("W15_average_rank", _PRICE_COLS + " avg_rank:f", """
    select security_id, trade_date, rank() over (partition by trade_date order by v) + (count(*) over (partition by trade_date, v) - 1) / 2.0 as avg_rank
    from (select *, floor(volume / 1000) as v from bars0) z""", "bars0")
def _(m):
    rows = m.raw_bars.select("security_id", "trade_date", F.floor(F.col("volume") / 1000).alias("v"))
    return ranking.with_tie_ranks(rows, ["trade_date"], "v", ["security_id"]).withColumn("avg_rank", ranking.average_rank())


@query("W16_member_intervals", "index_code:s exchange_code:s in_date:d out_date:d", "select * from members", "members")
def _(m):
    return scd2.member_intervals(m.index_snapshots)


@query("W17_attribute_intervals", "exchange_code:s level:s industry:s in_date:d out_date:d", "select * from inds", "inds")
def _(m):
    return scd2.attribute_intervals(m.industry_snapshots)


@query("W18_entry_hint", "index_code:s exchange_code:s in_date:d out_date:d", """
    select index_code, exchange_code, case when row_number() over (partition by index_code, exchange_code order by in_date) = 1
      and date '1995-01-02' <= in_date and security_id % 2 = 0 then date '1995-01-02' else in_date end as in_date, out_date from members""", "members")
def _(m):
    hinted = m.index_snapshots.join(m.listing.select("exchange_code", "security_id"), "exchange_code").withColumn(
        "in_date", F.when(F.col("security_id") % 2 == 0, F.lit("1995-01-02").cast("date"))
    )
    return scd2.member_intervals(hinted)


@query("W18_entry_hint_every_entry", "index_code:s exchange_code:s in_date:d out_date:d", """
    select index_code, exchange_code, in_date, out_date from members where security_id % 2 = 1
    union all select index_code, exchange_code, least(min(in_date), date '1995-01-02'), max(out_date) from members where security_id % 2 = 0 group by 1, 2""", "members")
def _(m):
    hinted = m.index_snapshots.join(m.listing.select("exchange_code", "security_id"), "exchange_code").withColumn(
        "in_date", F.when(F.col("security_id") % 2 == 0, F.lit("1995-01-02").cast("date"))
    )
    return scd2.member_intervals(hinted, hint_every_entry=True)


@query("W19_merge_intervals", "security_id:i in_date:d out_date:d", """
    select security_id, min(a) as in_date, max(b) as out_date from (
      select *, sum(fresh) over (partition by security_id order by a, b rows unbounded preceding) as g from (
        select *, case when a <= max(b) over (partition by security_id order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh
        from (select security_id, trade_date as a, trade_date + cast(1 + day(trade_date) % 9 as integer) as b from bars0) s) t) u
    group by security_id, g""", "bars0")
def _(m):
    spans = m.raw_bars.select("security_id", F.col("trade_date").alias("in_date"),
                              F.expr("date_add(trade_date, 1 + day(trade_date) % 9)").alias("out_date"))
    return scd2.merge_intervals(spans, ["security_id"])


@query("W20_weight_panel", "index_code:s exchange_code:s as_of_date:d confidence:s", """
    select distinct 'IDX_W' as index_code, exchange_code, as_of_date, 'tushare_weight' as confidence from index_snap""", "index_snap")
def _(m):
    panel = m.index_snapshots.select(F.col("exchange_code").alias("con_code"), F.col("as_of_date").alias("trade_date"))
    return scd2.snapshots_from_weights(panel.unionByName(panel), "IDX_W")


@query("W21_calendar", "cal_date:d is_open:i prev_open:d next_open:d", "select * from cal", "cal")
def _(m):
    return m.calendar


@query("W22_trading_days", "trade_date:d is_trading:b prev_day:d", """
    select cal_date as trade_date, is_open = 1 as is_trading, case when prev_open < cal_date then prev_open end as prev_day from cal""", "cal")
def _(m):
    every = m.calendar.select(F.col("cal_date").alias("trade_date"))
    return cal.previous_trading_day(m.calendar, cal.is_trading_day(m.calendar, every))


@query("W22_weekday_fallback", "trade_date:d", """
    select cast(d as date) as trade_date from (select unnest(generate_series(a, b, interval 1 day)) as d
      from (select min(trade_date) as a, max(trade_date) as b from bars0) s) t where isodow(d) <= 5""", "bars0")
def _(m):
    return cal.weekdays(m.spark, *m.raw_bars.agg(F.min("trade_date"), F.max("trade_date")).first())


@query("W23_rebased", "board:s trade_date:d rebased:r6", f"""
    select board, trade_date, nav / first_value(nav) over (partition by board order by trade_date) as rebased from {_NAV} n""", "rets listing")
def _(m):
    return pf.rebased(_pseudo_nav(m), ["board"])


@query("W24_pnl_vs_previous", "session_id:s mark_date:d pnl_vs_prev_mark:f2", """
    select session_id, mark_date, total_asset - lag(total_asset) over (partition by session_id order by mark_date) as pnl_vs_prev_mark from (
      select board as session_id, trade_date as mark_date, sum(cast(amount as decimal(18,2)))::double as total_asset
      from bars0 join listing using (security_id) group by 1, 2) z""", "bars0 listing")
def _(m):
    totals = m.raw_bars.join(m.listing, "security_id").groupBy(F.col("board").alias("session_id"), F.col("trade_date").alias("mark_date")).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total_asset"))
    return od.with_previous_mark(totals)


@query("W25_relative_strength", "security_id:i stock_return:f8 bench_return:f8 relative_strength:f8", """
    with dd as (select trade_date from bars0 group by 1 having trade_date <= date '1999-06-30' order by 1 desc limit 121),
    r as (select security_id, trade_date, px from rets where trade_date in (select trade_date from dd)),
    own as (select security_id, arg_max(px, trade_date) / arg_min(px, trade_date) - 1 as stock_return from r group by 1 having count(*) >= 2),
    them as (select * from r where security_id in (select security_id from members where in_date <= date '1999-06-30' and out_date > date '1999-06-30')),
    b as (select avg(l.px / f.px - 1) as bench_return from (select * from them where trade_date = (select min(trade_date) from them)) f
          join (select * from them where trade_date = (select max(trade_date) from them)) l using (security_id))
    select security_id, stock_return, bench_return, stock_return - bench_return as relative_strength from own, b""", "rets members")
def _(m):
    import datetime as dt

    return jd.relative_strength(m.bars, m.members, "IDX_A", dt.date(1999, 6, 30), window=120)


@query("W26_signal_lag", "security_id:i trade_date:d exec_date:d", """
    select security_id, trade_date, next_open as exec_date from bars0 join cal on cal_date = trade_date where next_open > trade_date""", "bars0 cal")
def _(m):
    return cal.take_effect(m.raw_bars.select("security_id", "trade_date"), m.calendar)[0]


@query("W26_dropped_signals", "security_id:i trade_date:d", """
    select security_id, trade_date from bars0 where trade_date = (select max(trade_date) from bars0)""", "bars0")
def _(m):
    return cal.take_effect(m.raw_bars.select("security_id", "trade_date"), m.calendar)[1]


@query("weights_top20_momentum", "trade_date:d exchange_code:s weight:f12", """
    select trade_date, exchange_code, 1.0 / count(*) over (partition by trade_date) as weight from (
      select f.trade_date, l.exchange_code, row_number() over (partition by f.trade_date order by value desc, exchange_code) as rn
      from fac f join listing l using (security_id) where factor_name = 'mom_20') z where rn <= 20""", "fac listing")
def _(m):
    panel = m.factors("mom_20").join(m.listing.select("security_id", "exchange_code"), "security_id")
    return wt.target_weights(panel, "equal", 20)


# ---- as-of and interval joins ----------------------------------------------------------


@query("J04_interval_join", "security_id:i trade_date:d industry:s", """
    select b.security_id, trade_date, i.industry from bars0 b
    left join inds i on i.security_id = b.security_id and i.in_date <= trade_date and i.out_date > trade_date""", "bars0 inds")
def _(m):
    return asof.attach_interval(m.raw_bars.select("security_id", "trade_date"), m.industries, ["security_id"], ["industry"])


@query("J04_index_members_by_day", "security_id:i trade_date:d", """
    select b.security_id, trade_date from bars0 b
    join members i on i.security_id = b.security_id and i.in_date <= trade_date and i.out_date > trade_date""", "bars0 members")
def _(m):
    return asof.inside_interval(m.raw_bars.select("security_id", "trade_date"), m.members, ["security_id"])


@query("J05_members_on", "exchange_code:s", """
    select distinct exchange_code from members where in_date <= date '1998-03-15' and out_date > date '1998-03-15'""", "members")
def _(m):
    import datetime as dt

    return asof.members_on(scd2.member_intervals(m.index_snapshots), "IDX_A", dt.date(1998, 3, 15))


@query("J05_industry_on", "exchange_code:s industry:s", """
    select exchange_code, industry from inds where in_date <= date '1998-03-15' and out_date > date '1998-03-15'""", "inds")
def _(m):
    import datetime as dt

    return asof.attribute_on(scd2.attribute_intervals(m.industry_snapshots), "sw_l1", dt.date(1998, 3, 15))


@query("J06_industry_within_index", "trade_date:d industry:s members:i", """
    select d.trade_date, i.industry, count(*) as members from (select distinct trade_date from bars0) d
    join inds i on i.in_date <= d.trade_date and i.out_date > d.trade_date
    join members x on x.security_id = i.security_id and x.in_date <= d.trade_date and x.out_date > d.trade_date group by 1, 2""", "bars0 inds members")
def _(m):
    both = asof.intersect(m.industries, m.members.select("security_id", "in_date", "out_date"), ["security_id"], [])
    return asof.active_counts(both, ["industry"], m.days)


@query("J06_suspended_members", "index_code:s security_id:i spells:i days:i", """
    select x.index_code, x.security_id, count(distinct s.spell) as spells, count(*) as days
    from (select security_id, suspend_date, suspend_date - cast(row_number() over (partition by security_id order by suspend_date) as integer) as spell
          from (select distinct security_id, suspend_date from susp) d) s
    join members x on x.security_id = s.security_id and x.in_date <= suspend_date and x.out_date > suspend_date group by 1, 2""", "susp members")
def _(m):
    spells = scd2.spans_of_days(m.suspensions, ["security_id"], "suspend_date").withColumn("spell", F.col("in_date"))
    met = asof.overlaps(m.members.select("index_code", "security_id", "in_date", "out_date"), spells, on=["security_id"], columns=["spell"])
    return met.groupBy("index_code", "security_id").agg(F.countDistinct("spell").alias("spells"), F.sum(F.date_diff("out_date", "in_date")).alias("days"))


@query("J09_industries_in_index_runs", "run_start:d run_end:d industry:s members:i days:i", """
    with run as (select min(d) as run_start, max(d) + 1 as run_end from (
        select d, d - cast(row_number() over (order by d) as integer) as g from (select distinct trade_date as d from bars0 where day(trade_date) between 5 and 20) x) y group by g)
    select run_start, run_end, industry, count(*) as members, sum(least(run_end, out_date) - greatest(run_start, in_date)) as days
    from run join inds on in_date < run_end and run_start < out_date group by 1, 2, 3""", "bars0 inds")
def _(m):
    runs = scd2.spans_of_days(m.raw_bars.where(F.dayofmonth("trade_date").between(5, 20)).withColumn("market", F.lit(1)), ["market"], "trade_date")
    runs = runs.select("in_date", "out_date", F.col("in_date").alias("run_start"), F.col("out_date").alias("run_end"))
    met = asof.overlaps(m.industries.select("industry", "security_id", "in_date", "out_date"), runs, columns=["run_start", "run_end"])
    return met.groupBy("run_start", "run_end", "industry").agg(F.count("*").alias("members"), F.sum(F.date_diff("out_date", "in_date")).alias("days"))


@query("J07_visible_item_on_day", "security_id:i value:f2", """
    select security_id, arg_max(net_profit, row(report_date, ann_date, update_flag)) as value from stmt where ann_date <= date '1999-05-01' group by 1""", "stmt")
def _(m):
    return asof.visible_item(m.statements, "net_profit", "1999-05-01")


@query("J07_visible_items_all_days", "security_id:i trade_date:d net_profit:f2 equity:f2", """
    select b.security_id, b.trade_date, arg_max(net_profit, row(report_date, ann_date, update_flag)) as net_profit,
           arg_max(equity, row(report_date, ann_date, update_flag)) as equity
    from bars0 b left join stmt s on s.security_id = b.security_id and s.ann_date <= b.trade_date group by 1, 2""", "bars0 stmt")
def _(m):
    return asof.attach_visible(m.raw_bars.select("security_id", "trade_date"), m.statements, ["net_profit", "equity"])


@query("J08_previous_open_day_join", "security_id:i trade_date:d move:f", """
    select b.security_id, b.trade_date, (b.close * b.adj_factor) / nullif(p.close * p.adj_factor, 0) - 1 as move
    from bars b join cal c on c.cal_date = b.trade_date
    join bars p on p.security_id = b.security_id and p.trade_date = c.prev_open where c.prev_open <> c.cal_date""", "bars cal")
def _(m):
    px = m.bars.select("security_id", "trade_date", pr.post_close().alias("px"))
    before = px.select("security_id", F.col("trade_date").alias("prev"), F.col("px").alias("p0"))
    linked = cal.link(px, m.calendar, "prev_open", "prev").join(before, ["security_id", "prev"])
    return linked.withColumn("move", F.try_divide("px", F.nullif("p0", F.lit(0.0))) - 1)


@query("J09_index_size_history", "index_code:s trade_date:d members:i", """
    select x.index_code, d.trade_date, count(*) as members from (select distinct trade_date from bars0) d
    join members x on x.in_date <= d.trade_date and x.out_date > d.trade_date group by 1, 2""", "bars0 members")
def _(m):
    return asof.active_counts(m.members, ["index_code"], m.days)


@query("C07_price_read_pre", "trade_date:d exchange_code:s open:f close:f", """
    select trade_date, exchange_code, open * k as open, close * k as close from (
      select b.*, l.exchange_code, adj_factor / nullif(last_value(adj_factor) over (partition by security_id order by trade_date
        rows between unbounded preceding and unbounded following), 0) as k
      from bars b join listing l using (security_id) where trade_date between date '1996-01-01' and date '1999-12-31') z""", "bars listing")
def _(m):
    import datetime as dt

    return rs.get_price(m.bars, m.listing, start=dt.date(1996, 1, 1), end=dt.date(2000, 12, 31), adjust="pre", version="1999-12-31")


@query("A17_index_equal_return", "index_code:s trade_date:d ret:f8 n:i", """
    select x.index_code, b.trade_date, avg(b.px / nullif(p.px, 0) - 1) as ret, count(*) as n
    from rets b join cal c on c.cal_date = b.trade_date join rets p on p.security_id = b.security_id and p.trade_date = c.prev_open
    join members x on x.security_id = b.security_id and x.in_date <= b.trade_date and x.out_date > b.trade_date
    where c.prev_open <> c.cal_date group by 1, 2""", "rets cal members")
def _(m):
    return pr.member_equal_returns(m.bars, m.members, m.calendar).withColumnRenamed("members", "n")


@query("A15_adjusted_grid", "trade_date:d main:f gem:f star:f bse:f", """
    select trade_date, max(close * adj_factor) filter (where board = 'main') as main, max(close * adj_factor) filter (where board = 'gem') as gem,
           max(close * adj_factor) filter (where board = 'star') as star, max(close * adj_factor) filter (where board = 'bse') as bse
    from bars join listing using (security_id) group by 1""", "bars listing")
def _(m):
    from barloom import rules

    px = m.bars.join(m.listing.select("security_id", "board"), "security_id").withColumn("px", pr.post_close())
    return px.groupBy("trade_date").pivot("board", list(rules.BOARDS)).agg(F.max("px"))


