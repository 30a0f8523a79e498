"""Aggregations: watermarks, coverage, distributions, metrics, session marks (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import rules
from barloom.functions import trading as tr
from barloom.operators import (
    asof, coverage as cv, health, judgment as jd, orders as od, performance as pf, prices as pr, publish as pb,
)
from barloom.plans import build, research as rs
from suite.base import query

NAMES = "('mom_20','mom_60','vol_20','turn_20','ep','bp')"


def _marked_tables(m):
    return {
        "security_master": (m.listing, None), "daily_bar": (m.raw_bars, "trade_date"),
        "daily_basic": (m.basic.where("trade_date <= '2000-06-30'"), "trade_date"), "suspend": (m.suspensions, "suspend_date"),
        "fin_statement": (m.statement_rows, "ann_date"),
    }


_MARKS = """select 'security_master' as tab, cast(null as date) as min_date, cast(null as date) as max_date, count(*) as n, 0 as days from listing
    union all select 'daily_bar', min(trade_date), max(trade_date), count(*), count(distinct trade_date) from bars0
    union all select 'daily_basic', min(trade_date), max(trade_date), count(*), count(distinct trade_date) from basic where trade_date <= date '2000-06-30'
    union all select 'suspend', min(suspend_date), max(suspend_date), count(*), count(distinct suspend_date) from susp
    union all select 'fin_statement', min(ann_date), max(ann_date), count(*), count(distinct ann_date) from stmt"""


@query("A01_table_watermarks", "tab:s min_date:d max_date:d n:i days:i ok:b", f"select *, n > 0 as ok from ({_MARKS}) z", "listing bars0 basic susp stmt")
def _(m):
    return health.watermarks(_marked_tables(m)).withColumnsRenamed({"table": "tab", "rows": "n"})


@query("A02_factor_watermarks", "factor_name:s min_date:d max_date:d n:i days:i securities:i", """
    select factor_name, min(trade_date) as min_date, max(trade_date) as max_date, count(*) as n, count(distinct trade_date) as days,
           count(distinct security_id) as securities from fac group by 1""", "fac")
def _(m):
    return cv.watermarks(m.factors()).withColumnRenamed("rows", "n")


@query("A03_finance_summary", "n:i securities:i ann_days:i min_ann:d max_ann:d min_report:d max_report:d bad_ann_lt_report:i n_income:i n_cashflow:i lag_days:i", """
    select count(*) as n, count(distinct security_id) as securities, count(distinct ann_date) as ann_days, min(ann_date) as min_ann, max(ann_date) as max_ann,
           min(report_date) as min_report, max(report_date) as max_report, count(*) filter (where ann_date < report_date) as bad_ann_lt_report,
           count(*) as n_income, 0 as n_cashflow, (select max(trade_date) from bars0) - max(ann_date) as lag_days from stmt""", "stmt bars0")
def _(m):
    return health.finance_summary(m.statements, m.raw_bars).withColumnRenamed("rows", "n")


@query("A04_exact_distinct", "month:d securities:i days:i", """
    select cast(date_trunc('month', trade_date) as date) as month, count(distinct security_id) as securities, count(distinct trade_date) as days from bars0 group by 1""", "bars0")
def _(m):
    return m.raw_bars.groupBy(F.trunc("trade_date", "month").alias("month")).agg(
        F.countDistinct("security_id").alias("securities"), F.countDistinct("trade_date").alias("days"))


@query("A05_announcement_months", "month:d n:i securities:i", """
    select cast(date_trunc('month', ann_date) as date) as month, count(*) as n, count(distinct security_id) as securities from stmt group by 1 order by 1 desc limit 24""", "stmt")
def _(m):
    return health.announcement_months(m.statements).withColumnRenamed("rows", "n")


@query("A06_last_known_name", "exchange_code:s name:s", """
    select exchange_code, 'second ' || name as name from listing""", "listing")
def _(m):
    base = m.listing.select("exchange_code", F.concat(F.lit("first "), "name").alias("name"), F.lit("1995-01-01").cast("date").alias("valid_from"))
    later = m.listing.select("exchange_code", F.concat(F.lit("second "), "name").alias("name"), F.lit("1999-01-01").cast("date").alias("valid_from"))
    return od.named(m.listing.select("exchange_code"), base.unionByName(later))


_COVERAGE = f"""select u.trade_date, n.factor_name, coalesce(f.k, 0) as n_rows, coalesce(f.k, 0) as n_securities, u.universe_size,
    coalesce(coalesce(f.k, 0) / nullif(u.universe_size, 0)::double, 0) as coverage
    from (select trade_date, count(*) filter (where is_suspended = 0) as universe_size from bars group by 1) u
    cross join (select unnest(['mom_20','mom_60','vol_20','turn_20','ep','bp']) as factor_name) n
    left join (select trade_date, factor_name, count(*) as k from fac group by 1, 2) f on f.trade_date = u.trade_date and f.factor_name = n.factor_name"""


@query("A07_factor_coverage", "trade_date:d factor_name:s n_rows:i n_securities:i universe_size:i coverage:f8", _COVERAGE, "bars fac")
def _(m):
    return cv.coverage(m.factors(), m.bars)


@query("A08_factor_distribution", "trade_date:d factor_name:s n_valid:i mean:f8 std:f8 p1:f8 p25:f8 p50:f8 p99:f8 coverage:f8", """
    select f.*, n_valid / u.n::double as coverage from (
      select trade_date, factor_name, count(*) as n_valid, avg(value) as mean, stddev_samp(value) as std, quantile_cont(value, 0.01) as p1,
             quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.99) as p99
      from fac group by 1, 2) f
    join (select trade_date, count(*) as n from bars0 group by 1) u using (trade_date)""", "fac bars0")
def _(m):
    return cv.distribution(m.stored_factors(), m.raw_bars)


@query("A09_coverage_series", "trade_date:d n_factor:i n_valid:i universe:i coverage:f8", """
    select f.*, u.n as universe, n_valid / u.n::double as coverage from (
      select trade_date, count(*) as n_factor, count(*) as n_valid from fac where factor_name = 'mom_20' group by 1 order by 1 desc limit 30) f
    join (select trade_date, count(*) as n from bars0 group by 1) u using (trade_date)""", "fac bars0")
def _(m):
    return cv.coverage_series(m.factors("mom_20"), m.raw_bars, "mom_20")


@query("A10_coverage_matrix", "trade_date:d factor_name:s n_valid:i universe:i coverage:f8 p50:f8 mean:f8", """
    select f.*, (select count(*) from bars0 where trade_date = f.trade_date) as universe,
           n_valid / (select count(*) from bars0 where trade_date = f.trade_date)::double as coverage from (
      select trade_date, factor_name, count(*) as n_valid, quantile_cont(value, 0.5) as p50, avg(value) as mean from fac
      where trade_date = (select max(trade_date) from fac) group by 1, 2) f""", "fac bars0")
def _(m):
    return cv.matrix(m.stored_factors(), m.raw_bars)


@query("A11_industry_distribution", "trade_date:d industry_name:s members:i weight:f8", """
    select trade_date, industry as industry_name, n as members, n / sum(n) over (partition by trade_date) as weight from (
      select d.trade_date, i.industry, count(*) as n from (select distinct trade_date from bars0) d
      join inds i on i.in_date <= d.trade_date and i.out_date > d.trade_date group by 1, 2) z""", "bars0 inds")
def _(m):
    return health.industry_distribution(m.industries, m.days, "sw_l1")


@query("A12_industry_coverage", "trade_date:d universe:i mapped:i n_industries:i coverage:f8", """
    select b.trade_date, count(*) as universe, count(i.industry) as mapped, count(distinct i.industry) as n_industries, count(i.industry) / count(*)::double as coverage
    from bars0 b left join inds i on i.security_id = b.security_id and i.in_date <= trade_date and i.out_date > trade_date group by 1""", "bars0 inds")
def _(m):
    return health.industry_coverage(m.industries, m.raw_bars, "sw_l1")


@query("A12_coverage_cube", "factor_name:s industry:s board:s grouping:i n_values:i n_securities:i", """
    select factor_name, industry, board, grouping(factor_name, industry, board) as grouping, count(*) as n_values, count(distinct f.security_id) as n_securities
    from fac f join bars0 b on b.security_id = f.security_id and b.trade_date = f.trade_date join listing l on l.security_id = f.security_id
    left join (select security_id, industry, in_date, out_date from inds) i on i.security_id = f.security_id and i.in_date <= f.trade_date and i.out_date > f.trade_date
    group by grouping sets ((factor_name, industry, board), (factor_name, industry), (factor_name, board), (factor_name), (industry), ())""", "fac bars0 listing inds")
def _(m):
    return cv.cube(m.factors(), m.raw_bars, m.listing, m.industries)


@query("A13_universe_sizes", "index_code:s trade_date:d members:i", """
    select x.index_code, d.trade_date, count(*) as members from (select distinct trade_date from bars0) d
    join members x on x.in_date <= d.trade_date and x.out_date > d.trade_date group by 1, 2
    union all select 'ALL', trade_date, count(*) from bars0 group by 2""", "bars0 members")
def _(m):
    return health.universe_sizes(m.members, m.raw_bars, m.days)


def _buckets_sql(price: str) -> str:
    return f"""select trade_date, factor_name, quintile, avg(fwd_ret) as mean_fwd_ret, count(*) as names, max(n) as n_names from (
      select *, greatest(1, cast(ceil(5 * (rn - 1) / nullif(n - 1, 0)::double) as bigint)) as quintile from (
        select f.trade_date, factor_name, c1.px / c0.px - 1 as fwd_ret, row_number() over (partition by f.trade_date, factor_name order by value, f.security_id) as rn,
               count(*) over (partition by f.trade_date, factor_name) as n
        from fac f join cal c on c.cal_date = f.trade_date
        join (select security_id, trade_date, {price} as px from bars) c0 on c0.security_id = f.security_id and c0.trade_date = f.trade_date
        join (select security_id, trade_date, {price} as px from bars) c1 on c1.security_id = f.security_id and c1.trade_date = c.next_open
        where c.next_open <> c.cal_date and c0.px > 0 and c1.px > 0) a) b where n >= 5 group by 1, 2, 3"""


@query("A14_quintile_forward_returns", "trade_date:d factor_name:s quintile:i mean_fwd_ret:f6 names:i n_names:i", _buckets_sql("close * adj_factor"), "fac cal bars")
def _(m):
    return cv.forward_buckets(m.stored_factors(), m.bars, m.calendar, min_names=5)


@query("A14_quintile_spread_raw_close", "trade_date:d factor_name:s n_names:i spread_q5_q1:f6", f"""
    select trade_date, factor_name, max(n_names) as n_names, coalesce(max(mean_fwd_ret) filter (where quintile = 5), 0) - coalesce(max(mean_fwd_ret) filter (where quintile = 1), 0) as spread_q5_q1
    from ({_buckets_sql('close')}) z group by 1, 2""", "fac cal bars")
def _(m):
    return cv.spreads(cv.forward_buckets(m.stored_factors(), m.bars, m.calendar, min_names=5, adjust="none"))


@query("A16_pivot_metric", "factor_name:s main:f8 gem:f8 star:f8 bse:f8", """
    select factor_name, avg(value) filter (where board = 'main') as main, avg(value) filter (where board = 'gem') as gem,
           avg(value) filter (where board = 'star') as star, avg(value) filter (where board = 'bse') as bse
    from fac join listing using (security_id) group by 1""", "fac listing")
def _(m):
    per = m.factors().join(m.listing.select("security_id", F.col("board").alias("weight_method")), "security_id").groupBy(
        "factor_name", "weight_method").agg(F.avg("value").alias("sharpe"))
    return rs.matrix(per, list(rules.BOARDS))


@query("A18_reject_reasons", "reason:s n:i", """
    select no_buy as reason, count(*) as n from (select case when suspended then 'suspended' when open <= 0 then 'no_price'
      when up_limit > 0 and close >= up_limit * (1.0::double - 0.0001::double) then 'limit_up' end as no_buy from exec) z where no_buy is not null group by 1""", "exec")
def _(m):
    reason = tr.buy_block(F.col("open"), F.col("close"), F.col("up_limit"), F.col("suspended"))
    return od.reject_counts(m.execution.withColumn("reason", reason))


@query("A19_histogram", "factor_name:s bin:i n:i", """
    select factor_name, least(cast(floor((value - lo) / nullif((hi - lo) / 30, 0)) as bigint), 29) as bin, count(*) as n
    from fac join (select factor_name, min(value) as lo, max(value) as hi from fac group by 1) e using (factor_name)
    group by 1, 2""", "fac")
def _(m):
    return cv.histogram(m.factors(), ["factor_name"])


_TOP = """(select trade_date, security_id, exchange_code, 1.0 / count(*) over (partition by trade_date) as weight from (
    select f.*, l.exchange_code, row_number() over (partition by f.trade_date order by value desc, l.exchange_code) as rn
    from fac f join listing l using (security_id) where factor_name = 'mom_20') t where rn <= 10)"""


def _top_weights(m):
    panel = m.factors("mom_20").join(m.listing.select("security_id", "exchange_code"), "security_id")
    return rs.weight_series(panel, rs.Spec(top_n=10))


@query("A20_signal_exposure", "trade_date:d industry:s signal_weight:f8 index_weight:f8 diff:f8", f"""
    select trade_date, industry, coalesce(s, 0) as signal_weight, coalesce(i, 0) as index_weight, coalesce(s, 0) - coalesce(i, 0) as diff from (
      select w.trade_date, coalesce(i.industry, 'UNKNOWN') as industry, sum(weight) as s from {_TOP} w
      left join inds i on i.security_id = w.security_id and i.in_date <= w.trade_date and i.out_date > w.trade_date group by 1, 2) x
    full join (select trade_date, industry, n / sum(n) over (partition by trade_date) as i from (
      select b.trade_date, coalesce(i.industry, 'UNKNOWN') as industry, count(*) as n from bars0 b
      join members x on x.security_id = b.security_id and x.in_date <= b.trade_date and x.out_date > b.trade_date
      left join inds i on i.security_id = b.security_id and i.in_date <= b.trade_date and i.out_date > b.trade_date group by 1, 2) q) y
    using (trade_date, industry)""", "fac listing inds bars0 members")
def _(m):
    index_rows = asof.inside_interval(m.raw_bars.select("security_id", "trade_date"), m.members, ["security_id"])
    return rs.signal_exposure(_top_weights(m), index_rows, m.industries)


_TRADE = """select g.security_id, case when now_sus then 'blocked' when now_up or now_down or any_st or n_suspended >= 3 or n_limit_up + n_limit_down >= 3
      or coalesce(date '1999-06-30' - ann > 90, false) then 'caution' else 'ok' end as status,
      n_limit_up, n_limit_down, n_suspended, any_st as is_st, last_suspend_date, ann as finance_ann_date, date '1999-06-30' - ann as finance_ann_lag_days from (
    select security_id, count(*) filter (where up) as n_limit_up, count(*) filter (where down) as n_limit_down, count(*) filter (where is_suspended = 1) as n_suspended,
           bool_or(is_st = 1) as any_st, bool_or(rn = 1 and is_suspended = 1) as now_sus, bool_or(rn = 1 and up) as now_up, bool_or(rn = 1 and down) as now_down
    from (select *, abs(close - up_limit) < 1e-6 as up, abs(close - down_limit) < 1e-6 as down, row_number() over (partition by security_id order by trade_date desc) as rn
          from lbars where trade_date <= date '1999-06-30') a where rn <= 20 group by 1) g
    left join (select security_id, max(suspend_date) as last_suspend_date from susp where suspend_date <= date '1999-06-30' group by 1) s using (security_id)
    left join (select security_id, max(ann_date) as ann from stmt where ann_date <= date '1999-06-30' group by 1) f using (security_id)"""


@query("A21_tradability", "security_id:i status:s n_limit_up:i n_limit_down:i n_suspended:i is_st:b last_suspend_date:d finance_ann_date:d finance_ann_lag_days:i",
       _TRADE, "lbars susp stmt")
def _(m):
    import datetime as dt

    return jd.tradability(m.limited_bars, m.suspensions, m.statements, dt.date(1999, 6, 30))


@query("A22_statement_lag", "security_id:i trade_date:d last_ann:d lag_days:i", """
    select b.security_id, b.trade_date, max(ann_date) as last_ann, b.trade_date - max(ann_date) as lag_days from bars0 b
    left join stmt s on s.security_id = b.security_id and s.ann_date <= b.trade_date group by 1, 2""", "bars0 stmt")
def _(m):
    spans = m.statement_rows.select("security_id", F.col("ann_date").alias("in_date"), F.col("ann_date").alias("last_ann"),
                                    F.lit(rules.OPEN_END).alias("out_date"))
    out = asof.attach_interval(m.raw_bars.select("security_id", "trade_date"), spans, ["security_id"], ["last_ann"])
    return out.withColumn("lag_days", F.date_diff("trade_date", "last_ann"))


_NAV = """(select board, trade_date, ret, case when min(ret) over w <= -1 then 0 else exp(sum(ln(case when ret > -1 then 1 + ret end)) over w) end as nav from (
    select l.board, trade_date, avg(ret) as ret from rets join listing l using (security_id) where ret is not null group by 1, 2) a
    window w as (partition by board order by trade_date))"""


def _nav(m):
    rets = pr.daily_returns(m.limited_bars).where("ret is not null")
    daily = rets.groupBy("board", "trade_date").agg(F.avg("ret").alias("ret"))
    return pf.with_nav(daily, ["board"])


@query("A23_performance_metrics", "board:s total_return:r6 ann_return:r6 ann_vol:r6 sharpe:r6 max_drawdown:f8 calmar:r6 hit_ratio:f8", f"""
    select board, total_return, ann as ann_return, vol as ann_vol, ann / vol as sharpe, mdd as max_drawdown, ann / abs(mdd) as calmar, hit as hit_ratio from (
      select board, nav1 / nav0 - 1 as total_return, pow(nav1 / nav0, 242.0::double / n) - 1 as ann, sd * sqrt(242.0::double) as vol, mdd, hit from (
        select board, arg_min(nav, trade_date) as nav0, arg_max(nav, trade_date) as nav1, count(ret) as n, stddev_samp(ret) as sd,
               min(nav / peak - 1) as mdd, avg(case when ret > 0 then 1.0 else 0.0 end) as hit
        from (select *, max(nav) over (partition by board order by trade_date) as peak from {_NAV} x) y group by 1) z) q""", "rets listing")
def _(m):
    return pf.metrics(_nav(m), ["board"])


@query("A24_excess_metrics", "board:s excess_total:r6 excess_ann_vol:r6 excess_ann_return:r6 info_ratio:r6", f"""
    select board, product(1 + er) - 1 as excess_total, stddev_samp(er) * sqrt(242.0::double) as excess_ann_vol, avg(er) * 242 as excess_ann_return,
           avg(er) * 242 / (stddev_samp(er) * sqrt(242.0::double)) as info_ratio from (
      select s.board, s.r - b.ret as er from (select *, nav / lag(nav) over (partition by board order by trade_date) - 1 as r from {_NAV} x) s
      join {_NAV} b on b.board = 'main' and b.trade_date = s.trade_date where s.r is not null and s.board <> 'main') z group by 1""", "rets listing")
def _(m):
    nav = _nav(m)
    return pf.excess_metrics(nav.where("board <> 'main'"), nav.where("board = 'main'").select("trade_date", "ret"), ["board"])


def _sessions(m):
    """One session per board: holds 100 shares of each of its securities."""
    pos = m.listing.select(F.col("board").alias("session_id"), "exchange_code", F.lit(100).alias("quantity"),
                                                      F.lit(50000.0).alias("cost"))
    sessions = m.listing.select(F.col("board").alias("session_id")).distinct().select(
        "session_id", F.lit(40000.0).alias("cash"), F.lit(100000.0).alias("initial_cash"), F.lit(90000.0).alias("rebalance_total"))
    return sessions, pos


@query("A25_session_marks", "session_id:s market_value:f2 total_asset:f2 pnl_vs_initial:f2 pnl_vs_rebalance:f2 return_vs_initial:f6 n_positions:i n_missing_quotes:i", """
    select *, 40000 + market_value as total_asset, 40000 + market_value - 100000 as pnl_vs_initial, 40000 + market_value - 90000 as pnl_vs_rebalance,
           (40000 + market_value) / 100000.0::double - 1 as return_vs_initial from (
      select board as session_id, coalesce(sum(coalesce(close, 0) * 100), 0) as market_value, count(*) as n_positions, count(*) filter (where close is null) as n_missing_quotes
      from listing l
      left join (select * from bars0 where trade_date = date '1999-06-30') b using (security_id) group by 1) z""", "listing bars0")
def _(m):
    import datetime as dt

    sessions, pos = _sessions(m)
    closes = m.raw_bars.where("trade_date = '1999-06-30'").join(m.listing, "security_id").select("exchange_code", F.col("close").alias("price"))
    return od.mark_sessions(sessions, pos, closes, dt.date(1999, 6, 30))


@query("A26_session_comparison", "session_id:s cash:f2 n_positions:i mark_date:d mark_total_asset:f2 error:s", """
    select s.session_id, case when k.n is not null then 40000.0 end as cash, case when k.n is not null then k.n end as n_positions, k.mark_date, k.total as mark_total_asset,
           case when k.n is null then 'not_found' end as error
    from (select distinct board as session_id from listing union all select 'nobody') s
    left join (select board as session_id, count(distinct security_id) as n, max(d) as mark_date, max(t) as total from listing
               join (select board, max(trade_date) as d, max(amount) as t from bars0 join listing using (security_id)
                     where trade_date = (select max(trade_date) from bars0) group by 1) x using (board) group by 1) k using (session_id)""", "listing bars0")
def _(m):
    sessions, pos = _sessions(m)
    last = m.raw_bars.agg(F.max("trade_date")).scalar()
    days = m.raw_bars.join(m.listing, "security_id")
    marks = days.groupBy(F.col("board").alias("session_id"), F.col("trade_date").alias("mark_date")).agg(
        F.max("amount").alias("total_asset")).withColumn("pnl_vs_initial", F.lit(0.0))
    on_last = marks.where(F.col("mark_date") == last).select("session_id").distinct()
    known = sessions.select("session_id", "cash").join(on_last, "session_id", "left_semi")
    asked = sessions.select("session_id").unionByName(m.spark.createDataFrame([("nobody",)], "session_id string"))
    return od.compare_sessions(asked, known, pos, marks.join(on_last, "session_id", "left_semi"))


@query("A27_metric_matrix", "run_id:s sharpe:r6 total_return:r6", f"""
    select board as run_id, ann / vol as sharpe, total_return from (
      select board, nav1 / nav0 - 1 as total_return, pow(nav1 / nav0, 242.0::double / n) - 1 as ann, sd * sqrt(242.0::double) as vol from (
        select board, arg_min(nav, trade_date) as nav0, arg_max(nav, trade_date) as nav1, count(ret) as n, stddev_samp(ret) as sd from {_NAV} x group by 1) z) q""", "rets listing")
def _(m):
    from barloom.sources import tables as tb

    figures = pf.metrics(_nav(m), ["board"]).withColumnRenamed("board", "run_id")
    meta = figures.select("run_id", F.current_timestamp().alias("created_at"), F.lit("mom_20").alias("factor"))
    return tb.metric_matrix(tb.pack_run(figures, meta, ["run_id"]))


@query("A28_rows_per_version", "trade_date:d row_count:i", "select trade_date, row_count + 1 as row_count from vers", "vers")
def _(m):
    again = m.versions.withColumn("row_count", F.col("row_count") + 1)
    odd = m.versions.withColumn("version", F.lit("unpublished"))
    return pb.version_counts(m.versions.unionByName(again).unionByName(odd))


@query("A29_latest_bar_date", "last_day:d n_codes:i", "select max(trade_date) as last_day, count(distinct security_id) as n_codes from bars0", "bars0")
def _(m):
    return health.bar_watermark(m.raw_bars).withColumnRenamed("max_date", "last_day")


@query("A30_provenance", "confidence:s n:i days:i", """
    select case when security_id % 3 = 0 then 'sina_include_date' else 'csindex_snapshot' end as confidence, count(*) as n, count(distinct as_of_date) as days
    from index_snap group by 1""", "index_snap")
def _(m):
    coded = m.index_snapshots.join(m.listing.select("exchange_code", "security_id"), "exchange_code")
    label = F.when(F.col("security_id") % 3 == 0, "sina_include_date").otherwise("csindex_snapshot")
    return build.provenance(coded.withColumn("confidence", label)).withColumnRenamed("rows", "n")
