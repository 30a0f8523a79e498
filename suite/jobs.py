"""User-level jobs (C rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.operators import (
    asof, coverage as cv, health, judgment as jd, orders as od, performance as pf, prices as pr, publish as pb,
    quality as q, weights as wt,
)
from barloom.plans import build, operations as ops, research as rs
from barloom.session import bucketed, durable
from suite.base import query
from suite.counts import _COVERAGE, _MARKS, _TOP, _TRADE, _buckets_sql, _marked_tables, _top_weights

DAY = dt.date(1999, 6, 30)
D = "date '1999-06-30'"


def _landed_bars(m):
    cols = ("trade_date", "open", "high", "low", "close", "pre_close", "volume", "amount", "adj_factor", "is_suspended", "security_id")
    return m.bars.select(*cols).join(m.listing.select("security_id", "exchange_code"), "security_id")


def _built_bars(m):
    raw = _landed_bars(m)
    adj = raw.where("security_id % 5 <> 0").select("exchange_code", "trade_date", "adj_factor")
    halted = raw.where("is_suspended = 1").select("exchange_code", F.col("trade_date").alias("suspend_date"))
    return build.daily_bars(raw.drop("adj_factor", "is_suspended", "security_id"), adj, halted, m.master.where("security_id % 10 <> 9"))


@query("C01_daily_bar_build", "trade_date:d security_id:i close:f adj_factor:f up_limit:f down_limit:f is_suspended:i is_st:i volume:i", """
    select trade_date, security_id, close, case when security_id % 5 = 0 then 1.0 else adj_factor end as adj_factor, up_limit, down_limit, is_suspended, is_st, volume
    from lbars where security_id % 10 <> 9""", "lbars")
def _(m):
    return _built_bars(m)[0]


@query("C01_rejected_codes", "trade_date:d exchange_code:s", "select trade_date, exchange_code from bars0 join listing using (security_id) where security_id % 10 = 9", "bars0 listing")
def _(m):
    return _built_bars(m)[1]


@query("C02_daily_basic_build", "trade_date:d security_id:i total_mv:f turnover_rate:f pe_ttm:f", """
    select trade_date, security_id, total_mv, turnover_rate, cast(null as double) as pe_ttm from basic""", "basic")
def _(m):
    coded = m.basic.join(m.listing.select("security_id", "exchange_code"), "security_id").drop("security_id")
    return build.daily_basics(coded, m.listing)


@query("C03_security_master_build", "security_id:i exchange_code:s board:s list_date:d valid_to:d", """
    select case when security_id % 3 <> 0 then security_id else
             (select max(security_id) from listing where security_id % 3 <> 0) + row_number() over (partition by security_id % 3 <> 0 order by exchange_code) end as security_id,
           exchange_code, board, coalesce(case when security_id % 4 <> 0 then list_date end, date '1990-01-01') as list_date, date '2099-12-31' as valid_to
    from master""", "master")
def _(m):
    listing = m.master.select("exchange_code", "name", F.when(F.col("security_id") % 4 != 0, F.col("list_date")).alias("list_date"))
    return build.security_master(listing, m.listing.where("security_id % 3 <> 0").select("exchange_code", "security_id"))


@query("C03_master_versions", "exchange_code:s name:s valid_from:d valid_to:d", """
    with pts as (select exchange_code, as_of_date, arg_max(name, known_on) as name from names where known_on <= date '1996-06-30' group by 1, 2),
    turns as (select *, lag(name) over (partition by exchange_code order by as_of_date) as was from pts qualify was is null or was <> name),
    spans as (select exchange_code, name, as_of_date, was is null as is_first, coalesce(lead(as_of_date) over (partition by exchange_code order by as_of_date), date '2099-12-31') as valid_to from turns)
    select l.exchange_code, coalesce(s.name, l.name) as name, case when s.is_first then least(s.as_of_date, l.list_date) else coalesce(s.as_of_date, l.list_date) end as valid_from,
           coalesce(s.valid_to, date '2099-12-31') as valid_to
    from master l left join spans s using (exchange_code)""", "master names")
def _(m):
    listing = m.master.select("exchange_code", "name", "list_date")
    return build.security_master(listing, m.listing.select("exchange_code", "security_id"), names=m.name_snapshots, version="1996-06-30")


@query("C01_bars_with_past_names", "security_id:i trade_date:d is_st:i up_limit:f2", """
    with pts as (select security_id, as_of_date, arg_max(name, known_on) as name from names group by 1, 2),
    spans as (select security_id, name, as_of_date, coalesce(lead(as_of_date) over (partition by security_id order by as_of_date), date '2099-12-31') as until from pts),
    flagged as (select b.security_id, b.trade_date, b.close, l.board, coalesce(cast(contains(s.name, 'ST') as integer), 0) as is_st
      from bars0 b join listing l using (security_id) left join spans s on s.security_id = b.security_id and s.as_of_date <= b.trade_date and s.until > b.trade_date)
    select security_id, trade_date, is_st, round(close * (1 + cast(case when is_st = 1 and board = 'main' then 0.05 when board = 'main' then 0.10 when board = 'bse' then 0.30 else 0.20 end as double)) + 1e-9, 2) as up_limit
    from flagged""", "bars0 listing names")
def _(m):
    m = m.stored()
    master = build.security_master(m.master.select("exchange_code", "name", "list_date"), m.listing.select("exchange_code", "security_id"), names=m.name_snapshots)
    landed = m.raw_bars.join(m.listing.select("security_id", "exchange_code"), "security_id").drop("security_id").withColumn("pre_close", F.col("close"))
    none = landed.select("exchange_code", "trade_date", F.lit(1.0).alias("adj_factor"))
    halted = landed.limit(0).select("exchange_code", F.col("trade_date").alias("suspend_date"))
    return build.daily_bars(landed, none, halted, master)[0]


@query("C04_statement_build", "security_id:i ann_date:d report_date:d stmt_type:s update_flag:i keys:s total:f2", """
    select security_id, ann_date, report_date, 'income' as stmt_type, update_flag, 'net_profit,revenue' as keys, net_profit + revenue as total from stmt
    union all select security_id, ann_date, report_date, 'balance', update_flag, 'equity', equity from stmt
    union all select security_id, ann_date, report_date, 'cashflow', 0, 'cfo', net_profit from stmt where update_flag = 0""", "stmt")
def _(m):
    rows = m.statement_rows.join(m.listing.select("security_id", "exchange_code"), "security_id").drop("security_id")
    key = ["exchange_code", "ann_date", "report_date", "update_flag"]
    parts = {
        "income": rows.select(*key, "revenue", F.col("net_profit").alias("n_income_attr_p")),
        "balancesheet": rows.select(*key, F.col("equity").alias("total_hldr_eqy_exc_min_int"), F.lit(None).cast("double").alias("total_assets")),
        "cashflow": rows.where("update_flag = 0").select(*key[:3], F.col("net_profit").alias("n_cashflow_act")),
    }
    out = build.statements(parts, m.listing)
    return out.select("*", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("keys"),
                      F.aggregate(F.map_values("fields"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("C05_index_member_build", "index_code:s security_id:i in_date:d out_date:d", "select * from members", "members")
def _(m):
    return build.index_members(m.index_snapshots, m.listing)


@query("C05_industry_member_build", "security_id:i level:s industry:s in_date:d out_date:d", "select * from inds", "inds")
def _(m):
    return build.industry_members(m.industry_snapshots, m.listing)


@query("C06_universe_index", "trade_date:d exchange_code:s", """
    select c.cal_date as trade_date, x.exchange_code from cal c join members x on x.in_date <= c.cal_date and x.out_date > c.cal_date
    join master l on l.security_id = x.security_id left join lbars b on b.security_id = x.security_id and b.trade_date = c.cal_date
    where c.is_open = 1 and coalesce(b.is_suspended, 0) <> 1 and coalesce(b.is_st, 0) <> 1 and l.list_date <= c.cal_date - 120
      and not coalesce(b.is_suspended = 0 and abs(b.close - b.up_limit) < 1e-6, false)""", "cal members master lbars")
def _(m):
    return rs.universe(m.limited_bars, m.master, index_code="IDX_A", members=m.members, calendar=m.calendar,
                       filters=("st", "suspended", "listed_days<120", "limit_up_open"))


@query("C07_price_read_post", "trade_date:d exchange_code:s open:f high:f low:f close:f volume:i", """
    select trade_date, exchange_code, open * adj_factor as open, high * adj_factor as high, low * adj_factor as low, close * adj_factor as close, volume
    from bars join listing using (security_id)""", "bars listing")
def _(m):
    return rs.get_price(m.bars, m.listing)


@query("C08_industry_read", "exchange_code:s industry:s", f"select exchange_code, industry from inds where in_date <= {D} and out_date > {D}", "inds")
def _(m):
    return rs.get_industry(m.industries, m.listing, DAY)


@query("C09_value_factors", "security_id:i trade_date:d ep:f10 bp:f10", "select security_id, trade_date, ep, bp from fac_value", "fac_value")
def _(m):
    from barloom.operators import factors as fct

    return fct.value_factors(m.basic, m.statements, ["ep", "bp"]).where("ep is not null")


@query("C10_seed_factors", "trade_date:d security_id:i factor_name:s version:s value:f8", "select *, 'v1' as version from fac", "fac")
def _(m):
    return m.factors()


@query("C10_factor_range", "trade_date:d security_id:i factor_name:s value:f8", """
    select trade_date, security_id, factor_name, value from fac where factor_name in ('mom_20', 'ep') and trade_date between date '1998-01-01' and date '1998-12-31'""", "fac")
def _(m):
    from barloom.operators import factors as fct

    return fct.compute(m.bars, m.basic, m.statements, names=["mom_20", "ep"], bound=190, start=dt.date(1998, 1, 1), end=dt.date(1998, 12, 31))


def _late(m):
    """Inputs before and after: bars and ratios of some days come late, some closes and statements are corrected."""
    from barloom.operators import refresh

    late = (F.col("security_id") * 7 + F.dayofyear("trade_date")) % 97 == 0
    bent = (F.col("security_id") % 13 == 0) & (F.dayofyear("trade_date") == 100)
    bars = m.bars.where(~late).withColumn("close", F.when(bent, F.col("close") * 1.01).otherwise(F.col("close")))
    told = m.statements.where(~((F.col("security_id") % 17 == 0) & (F.month("report_date") == 3)))
    return refresh, refresh.Inputs(bars, m.basic.where(~late), told), refresh.Inputs(m.bars, m.basic, m.statements)


@query("C10_refreshed_factors", "trade_date:d security_id:i factor_name:s version:s value:f8", "select *, 'v1' as version from fac", "fac")
def _(m):
    from barloom.operators import factors as fct

    refresh, before, after = _late(m.stored("statement_rows", columns=("close", "volume", "adj_factor")))
    bound = fct.lookback_days(60)
    stored = bucketed(fct.compute(*before, bound=bound), "factors", "security_id", ["factor_name", "trade_date"])  # the table as it stood
    return refresh.refresh(stored, before, after, bound=bound).table


@query("C10_dirty_ranges", "security_id:i in_date:d out_date:d", """
    with late as (select distinct security_id, trade_date from bars0 where (security_id * 7 + dayofyear(trade_date)) % 97 = 0 or (security_id % 13 = 0 and dayofyear(trade_date) = 100)),
    cut as (select *, case when trade_date <= lag(trade_date) over (partition by security_id order by trade_date) + 191 then 0 else 1 end as fresh from late),
    runs as (select *, sum(fresh) over (partition by security_id order by trade_date) as g from cut)
    select security_id, min(trade_date) as in_date, max(trade_date) + 191 as out_date from runs group by security_id, g""", "bars0")
def _(m):
    from barloom.operators import factors as fct

    refresh, before, after = _late(m)
    return refresh.dirty_ranges(refresh.changed_days(before.bars, after.bars, ["close", "adj_factor"]), fct.lookback_days(60))


@query("C11_factor_read", "trade_date:d exchange_code:s value:f8", """
    select trade_date, exchange_code, value from fac join listing using (security_id) where factor_name = 'bp' and trade_date <= date '1999-12-31'""", "fac listing")
def _(m):
    return rs.get_factor(m.factors("bp"), m.listing, "bp", version="1999-12-31")


_RANKS = """select *, rank() over d + (count(*) over t - 1) / 2.0 as dr, count(*) over (partition by trade_date) as dn,
    rank() over i + (count(*) over it - 1) / 2.0 as ir, count(*) over (partition by trade_date, industry) as ic
    from rows_in window d as (partition by trade_date order by value), t as (partition by trade_date, value),
      i as (partition by trade_date, industry order by value), it as (partition by trade_date, industry, value)"""

_PANEL = """select f.trade_date, l.exchange_code, f.value, coalesce(i.industry, 'UNKNOWN') as industry
    from fac f join bars b on b.security_id = f.security_id and b.trade_date = f.trade_date join master l on l.security_id = f.security_id
    left join inds i on i.security_id = f.security_id and i.in_date <= f.trade_date and i.out_date > f.trade_date
    where b.is_st <> 1 and b.is_suspended <> 1 and l.list_date <= b.trade_date - 120 and factor_name = 'mom_20'"""


def _weights_sql(rows: str) -> str:
    return f"""with rows_in as ({rows}), r as ({_RANKS}), k as (select trade_date, count(distinct industry) as k from rows_in group by 1)
      select trade_date, exchange_code, 'equal' as weight_method, 1.0::double / dn as weight from r
      union all select trade_date, exchange_code, 'factor_rank', dr / (dn * (dn + 1) / 2.0) from r
      union all select r.trade_date, exchange_code, 'industry_neutral', ir / (ic * (ic + 1) / 2.0) / k.k from r join k using (trade_date)"""


_METHODS = ("equal", "factor_rank", "industry_neutral")


@query("C12_target_weights", "trade_date:d exchange_code:s weight_method:s weight:f10", _weights_sql(_PANEL), "fac bars master inds")
def _(m):
    m, spec = m.stored(), rs.Spec(methods=_METHODS)
    panel = rs.panel(m.limited_bars, m.factors("mom_20"), m.master, spec, industry=m.industries)
    return wt.target_weights(durable(panel), list(_METHODS))


@query("C13_weight_series_top", "trade_date:d exchange_code:s weight_method:s weight:f10", _weights_sql(
    f"select * from ({_PANEL}) p qualify row_number() over (partition by trade_date order by value desc, exchange_code) <= 10"), "fac bars master inds")
def _(m):
    spec = rs.Spec(methods=_METHODS, top_n=10)
    panel = rs.panel(m.limited_bars, m.factors("mom_20"), m.master, spec, industry=m.industries)
    return rs.weight_series(panel, spec)


@query("C14_normalised_weights", "trade_date:d security_id:i weight:f10", """
    select trade_date, security_id, w / sum(w) over (partition by trade_date) as weight from (
      select trade_date, security_id, case when security_id % 9 = 0 then null when security_id % 8 = 0 then -1.0 else volume / 1000.0::double end as w from bars0) z where w > 0""", "bars0")
def _(m):
    k = F.col("security_id")
    w = F.when(k % 9 == 0, F.when(k % 2 == 0, F.lit(float("nan")))).when(k % 8 == 0, -1.0).otherwise(F.col("volume") / 1000.0)
    return wt.normalized(m.raw_bars.select("trade_date", "security_id", w.alias("weight")), ["trade_date"])


@query("C15_signal_meta", "trade_date:d factor_name:s n_names:i weight_sum:f8 non_tradable_count:i", f"""
    select w.trade_date, 'mom_20' as factor_name, count(*) as n_names, sum(weight) as weight_sum,
           count(*) filter (where is_suspended = 1 or close >= up_limit * (1 - 0.0001::double) or close <= down_limit * (1 + 0.0001::double)) as non_tradable_count
    from {_TOP} w join lbars b on b.security_id = w.security_id and b.trade_date = w.trade_date group by 1""", "fac listing lbars")
def _(m):
    weights = _top_weights(m)
    return rs.signal_meta(weights, rs.tradability_preview(weights, m.limited_bars), rs.Spec(top_n=10), dataset_version="2001-12-31")


@query("C16_sized_holdings", "exec_date:d security_id:i want:i shares:i reason:s", f"""
    select exec_date, security_id, want, case when reason is not null then 0 when volume > 0 then least(want, cap) else want end as shares, reason from (
      select *, case when close is null then 'no_bar' when want <= 0 then null when suspended then 'suspended' when open <= 0 then 'no_price'
          when close >= up_limit * (1.0::double - 0.0001::double) then 'limit_up' when volume > 0 and cap <= 0 then 'adv_limit' end as reason from (
        select w.security_id, c.next_open as exec_date, e.*, coalesce(cast(floor((w.weight * 100000000.0::double) / e.open / 100) * 100 as bigint), 0) as want,
               coalesce(cast(floor(floor(e.volume * 0.1::double) / 100) * 100 as bigint), 0) as cap
        from {_TOP} w join cal c on c.cal_date = w.trade_date
        left join (select security_id as sid, trade_date as td, open, close, up_limit, suspended, volume from exec) e on e.sid = w.security_id and e.td = c.next_open
        where c.next_open <> c.cal_date) a) b""", "fac listing cal exec")
def _(m):
    from barloom.operators import calendar as cal

    acting, _ = cal.take_effect(_top_weights(m), m.calendar)
    return od.size_targets_capped(acting.select("exec_date", "security_id", "weight"), m.execution, equity=100_000_000.0, max_participation=0.1)


def _run_sql(source, by):
    """Steps of a portfolio run as SQL, ending in `daily`; written from the rules of the run, per `by` columns."""
    cols, of = "".join(f"{x}, " for x in by), lambda t: "".join(f"{t}.{x}, " for x in by)
    using, same = ", ".join([*by, "d"]), lambda a, b: "".join(f" and {a}.{x} = {b}.{x}" for x in by)
    part = f"partition by {', '.join(by)} " if by else ""
    return f"""acts as (select {cols}c.next_open as d, w.security_id, weight from {source} w join cal c on c.cal_date = w.trade_date where c.next_open <> c.cal_date),
    met as (select a.*, e.mark / e.open as inside, e.security_id is null or e.suspended or e.close >= e.up_limit * (1.0::double - 0.0001::double) as no_buy
      from acts a left join exec e on e.security_id = a.security_id and e.trade_date = a.d),
    hold as (select * from met where not no_buy),
    steps as (select *, lead(d) over ({part}order by d) as nd from (select distinct {cols}d from acts) z),
    days as (select s.*, c.cal_date as day from steps s join cal c on c.is_open = 1 and c.cal_date >= s.d and (s.nd is null or c.cal_date < s.nd)),
    moves as (select {cols}d, sum(greatest(x, 0)) as bought, sum(greatest(-x, 0)) as sold from (
      select {cols}d, security_id, sum(x) as x from (select {cols}d, security_id, weight as x from hold
        union all select {cols}nd, security_id, -weight from hold join steps using ({using}) where nd is not null) a group by all) b group by all),
    held as (select {of('g')}g.day, weight, 1 as n, weight * case when g.day = g.d then h.inside - 1 else coalesce(b.ret, 0) end as x
      from days g join hold h using ({using}) left join rets b on b.security_id = h.security_id and b.trade_date = g.day),
    gone as (select {of('h')}s.nd as day, h.security_id, weight from hold h join steps s using ({using}) where s.nd is not null),
    shut as (select {of('g')}g.day, 0 as weight, 0 as n, g.weight * (coalesce((1 + coalesce(b.ret, 0)) / (e.mark / e.open), 1) - 1) as x
      from gone g left join rets b on b.security_id = g.security_id and b.trade_date = g.day left join exec e on e.security_id = g.security_id and e.trade_date = g.day),
    earned as (select {cols}day, sum(x) as gross, sum(weight) as held, sum(n) as n_positions from (select * from held union all select * from shut) z group by all),
    rejects as (select {cols}day, count(*) as n_rejects from (select {cols}d as day from met where no_buy
      union all select {of('g')}g.day from gone g left join exec e on e.security_id = g.security_id and e.trade_date = g.day
        where not exists (select 1 from acts a where a.security_id = g.security_id and a.d = g.day{same('a', 'g')})
          and (e.security_id is null or e.suspended or e.close <= e.down_limit * (1.0::double + 0.0001::double))) z group by all),
    daily as (select {of('g')}g.day, coalesce(gross, 0) as gross, 1 - coalesce(held, 0) as cash_ratio, coalesce(n_positions, 0) as n_positions,
        coalesce(bought + sold, 0) as turnover, coalesce((bought + sold) * 0.0008::double + sold * 0.0005::double, 0) as cost, coalesce(n_rejects, 0) as n_rejects
      from days g left join earned e on e.day = g.day{same('e', 'g')} left join moves m on m.d = g.day{same('m', 'g')}
      left join rejects r on r.day = g.day{same('r', 'g')})"""


def _series(m):
    m = m.stored("calendar")
    rets = pr.daily_returns(m.bars).select("security_id", "trade_date", "ret")
    return pf.portfolio_series(_top_weights(m), rets, m.execution, m.calendar, by=["factor_name", "weight_method"])


@query("C17_portfolio_series", "trade_date:d gross:f8 cash_ratio:f8 n_positions:i turnover:f8 cost:f8 ret:f8 n_rejects:i", f"""
    with {_run_sql(_TOP, [])} select day as trade_date, gross, cash_ratio, n_positions, turnover, cost, gross - cost as ret, n_rejects from daily""", "fac listing cal exec rets")
def _(m):
    return _series(m)


@query("C18_benchmark_series", "index_code:s trade_date:d ret:f8 mode:s", """
    select 'IDX_A' as index_code, b.trade_date, avg(b.px / nullif(p.px, 0) - 1) as ret, 'index_members_equal' as mode
    from rets b join cal c on c.cal_date = b.trade_date join rets p on p.security_id = b.security_id and p.trade_date = c.prev_open
    join members x on x.security_id = b.security_id and x.in_date <= b.trade_date and x.out_date > b.trade_date
    where c.prev_open <> c.cal_date group by 2
    union all select exchange_code, trade_date, ret, 'security_price' from rets join listing using (security_id) where ret is not null""", "rets cal members listing")
def _(m):
    synthetic = pr.member_equal_returns(m.bars, m.members, m.calendar)
    coded = pr.daily_returns(m.bars).join(m.listing.select("security_id", F.col("exchange_code").alias("index_code")), "security_id")
    return pr.benchmark_returns(coded.select("index_code", "trade_date", "ret"), synthetic)


def _cells(m):
    names = ["mom_20", "ep"]
    spec = rs.Spec(methods=_METHODS, top_n=10, factors=tuple(names))
    panel = rs.panel(m.limited_bars, m.factors(*names), m.master, spec, industry=m.industries, selected=True)
    weights = rs.weight_series(panel, spec)
    return weights, spec


@query("C19_experiment_matrix", "factor_name:s weight_method:s status:s total_return:r6 turnover:f6 avg_cash:f6 hit_ratio:f6 n_rejects:i excess_total:r6 is_best:b", f"""
    with panel as (select f.trade_date, f.security_id, f.factor_name, l.exchange_code, f.value, coalesce(i.industry, 'UNKNOWN') as industry
        from fac f join bars b on b.security_id = f.security_id and b.trade_date = f.trade_date join master l on l.security_id = f.security_id
        left join inds i on i.security_id = f.security_id and i.in_date <= f.trade_date and i.out_date > f.trade_date
        where b.is_st <> 1 and b.is_suspended <> 1 and l.list_date <= b.trade_date - 120 and factor_name in ('mom_20', 'ep')
        qualify row_number() over (partition by f.factor_name, f.trade_date order by f.value desc, l.exchange_code) <= 10),
    r as (select *, rank() over (partition by factor_name, trade_date order by value) + (count(*) over (partition by factor_name, trade_date, value) - 1) / 2.0 as dr,
        count(*) over (partition by factor_name, trade_date) as dn, rank() over (partition by factor_name, trade_date, industry order by value)
          + (count(*) over (partition by factor_name, trade_date, industry, value) - 1) / 2.0 as ir, count(*) over (partition by factor_name, trade_date, industry) as ic from panel),
    k as (select factor_name, trade_date, count(distinct industry) as k from panel group by 1, 2),
    w as (select factor_name, 'equal' as weight_method, trade_date, security_id, 1.0::double / dn as weight from r
      union all select factor_name, 'factor_rank', trade_date, security_id, dr / (dn * (dn + 1) / 2.0) from r
      union all select r.factor_name, 'industry_neutral', r.trade_date, security_id, ir / (ic * (ic + 1) / 2.0) / k.k from r join k using (factor_name, trade_date)),
    {_run_sql("w", ["factor_name", "weight_method"])},
    nav as (select *, gross - cost as ret from daily),
    curve as (select *, case when min(ret) over k <= -1 then 0 else exp(sum(ln(case when ret > -1 then 1 + ret end)) over k) end as nav from nav
      window k as (partition by factor_name, weight_method order by day)),
    peaks as (select *, max(nav) over (partition by factor_name, weight_method order by day) as peak, nav / lag(nav) over (partition by factor_name, weight_method order by day) - 1 as s from curve),
    base as (select b.trade_date as day, avg(b.px / nullif(p.px, 0) - 1) as b from rets b join cal c on c.cal_date = b.trade_date join rets p on p.security_id = b.security_id and p.trade_date = c.prev_open
      join members x on x.security_id = b.security_id and x.in_date <= b.trade_date and x.out_date > b.trade_date where c.prev_open <> c.cal_date group by 1),
    ex as (select factor_name, weight_method, product(1 + s - b) - 1 as excess_total from peaks join base using (day) where s is not null and b is not null group by 1, 2 having count(*) >= 2),
    figures as (select factor_name, weight_method, arg_max(nav, day) / arg_min(nav, day) - 1 as total_return, avg(turnover) as turnover, avg(cash_ratio) as avg_cash,
      avg(case when ret > 0 then 1.0 else 0.0 end) as hit_ratio, sum(n_rejects) as n_rejects from peaks group by 1, 2)
    select f.*, 'ok' as status, excess_total, rank() over (order by hit_ratio desc nulls last, factor_name, weight_method) = 1 as is_best
    from figures f left join ex using (factor_name, weight_method)""", "fac bars master inds cal exec rets members")
def _(m):
    m = m.stored("calendar", columns=("open", "close", "volume", "pre_close", "adj_factor", "is_suspended"))
    weights, _ = _cells(m)
    benchmark = pr.member_equal_returns(m.bars, m.members, m.calendar)
    out = rs.experiment(weights, m.bars, m.execution, m.calendar, benchmark=benchmark)
    summary = durable(rs.with_failed_cells(rs.cells(["mom_20", "ep"], list(_METHODS), m.spark), out))
    best = rs.best_cell(summary, "hit_ratio").select("factor_name", "weight_method", F.lit(True).alias("is_best"))
    return summary.join(best, ["factor_name", "weight_method"], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))


@query("C20_factor_monitor", "trade_date:d factor_name:s level:s coverage:f8", f"""
    select trade_date, factor_name, 'warn' as level, coverage from ({_COVERAGE}) c where coverage < 0.9
    union all select trade_date, factor_name, 'error', 0 from ({_COVERAGE}) c where n_securities = 0""", "bars fac")
def _(m):
    return cv.alerts(cv.coverage(m.factors(), m.bars))


@query("C20_monitor_spreads", "trade_date:d factor_name:s n_names:i spread_q5_q1:f6", f"""
    select trade_date, factor_name, max(n_names) as n_names, coalesce(max(mean_fwd_ret) filter (where quintile = 5), 0) - coalesce(max(mean_fwd_ret) filter (where quintile = 1), 0) as spread_q5_q1
    from ({_buckets_sql('close * adj_factor')}) z group by 1, 2""", "fac cal bars")
def _(m):
    return ops.monitor(m.stored_factors(), m.bars, m.calendar, min_names=5)["spreads"]


_CARDS = f"""
    with today as (select f.*, i.industry from fac f left join inds i on i.security_id = f.security_id and i.in_date <= trade_date and i.out_date > trade_date where trade_date = {D}),
    p as (select security_id, factor_name, value, cume_dist() over (partition by factor_name order by value) as pm,
                 case when industry is not null then cume_dist() over (partition by factor_name, industry order by value) end as pi from today),
    w as (select security_id, max(value) filter (where factor_name = 'mom_20') as mom_20, max(pm) filter (where factor_name = 'mom_20') as mom_p, max(pm) filter (where factor_name = 'vol_20') as vol_p,
                 max(pm) filter (where factor_name = 'ep') as ep_p, max(pm) filter (where factor_name = 'turn_20') as turn_p, max(pm) filter (where factor_name = 'bp') as bp_p from p group by 1),
    dd as (select trade_date from bars0 group by 1 having trade_date <= {D} order by 1 desc limit 121),
    own as (select security_id, arg_max(px, trade_date) / arg_min(px, trade_date) - 1 as sr, min(trade_date) as d0, max(trade_date) as d1 from rets
            where trade_date in (select trade_date from dd) group by 1 having count(*) >= 2),
    memb as (select * from rets where trade_date in (select trade_date from dd) and security_id in (select security_id from members where in_date <= {D} and out_date > {D})),
    br as (select avg(l.px / f.px - 1) as b from (select * from memb where trade_date = (select min(trade_date) from memb)) f
           join (select * from memb where trade_date = (select max(trade_date) from memb)) l using (security_id)),
    t as ({_TRADE}),
    c as (select l.security_id, l.exchange_code, 100 * mom_p as momentum, 100 * (1 - vol_p) as volatility, 100 * ep_p as valuation, 100 * (1 - turn_p) as turnover, 100 * bp_p as quality,
            own.sr - br.b as rs, coalesce(t.status, 'blocked') as status, (mom_p is not null)::int + (vol_p is not null)::int + (ep_p is not null)::int + (turn_p is not null)::int + (bp_p is not null)::int as k
          from listing l left join w using (security_id) left join own using (security_id) left join t using (security_id), br)
    select *, case when status = 'blocked' then '偏弱' when comp is null and rs is null then 'unknown' when x >= 58 then '偏强' when x <= 42 then '偏弱' else '中性' end as stance from (
      select *, coalesce(comp, 50) + greatest(least(coalesce(rs, 0) * 100, 10), -10) as x from (
        select *, (coalesce(momentum, 0) + coalesce(volatility, 0) + coalesce(valuation, 0) + coalesce(turnover, 0) + coalesce(quality, 0)) / nullif(k, 0) as comp from c) a) b"""
_CARD_VIEWS = "fac inds bars0 rets members lbars susp stmt listing"


def _cards(m):
    return jd.cards(m.listing, m.limited_bars, m.factors(), m.members, m.industries, m.statements, m.suspensions, DAY, benchmark="IDX_A", window=120)


@query("C21_security_cards", "exchange_code:s momentum:f6 volatility:f6 valuation:f6 turnover:f6 quality:f6 comp:f6 stance:s rs:f6 status:s", _CARDS, _CARD_VIEWS)
def _(m):
    return _cards(m.stored("statement_rows", "industries")).withColumnsRenamed({"composite": "comp", "relative_strength": "rs", "tradability": "status"})


@query("L10_cards_of_signal", "exchange_code:s comp:f6 stance:s", f"""
    select exchange_code, comp, stance from ({_CARDS}) c where exchange_code in (
      select l.exchange_code from fac f join listing l using (security_id) where factor_name = 'turn_20' and trade_date = {D} order by value desc, l.exchange_code limit 8)""", _CARD_VIEWS)
def _(m):
    m = m.stored("statement_rows", "industries")
    day = m.factors("turn_20").where(F.col("trade_date") == F.lit(DAY)).join(m.listing.select("security_id", "exchange_code"), "security_id")
    weights = wt.target_weights(day, "factor_rank", 8).where("weight > 0")
    return jd.cards_of_signal(_cards(m), weights, 8).withColumnRenamed("composite", "comp")


# ---- quality, publication, status -----------------------------------------------------------


def _quality_tables(m, factors=None):
    return q.Tables(m.limited_bars.drop("board", "exchange_code"), m.master, m.calendar, m.statements,
                    m.factors("mom_20") if factors is None else factors,
                    m.raw_bars.where("security_id % 2 = 0").join(m.listing.select("security_id", "exchange_code"), "security_id")
                    .withColumn("close", F.when(F.dayofmonth("trade_date") == 5, F.col("close") * 1.5).otherwise(F.col("close"))))


_ROW_COUNT = """select d.trade_date, case when got < 15 then false when prev >= 15 then abs(got - prev) / prev::double <= 0.05 else listed > 0 and got >= listed * 0.9 end as passed from (
    select a.trade_date, a.got, coalesce(b.got, 0) as prev, (select count(*) from master m where m.list_date <= a.trade_date) as listed
    from (select trade_date, count(*) as got from bars0 group by 1) a join cal c on c.cal_date = a.trade_date
    left join (select trade_date, count(*) as got from bars0 group by 1) b on b.trade_date = c.prev_open and c.prev_open <> c.cal_date) d"""

_ADJ = """select d.trade_date, count(x.security_id) = 0 as passed from (select distinct trade_date from bars0) d left join (
    select b.trade_date, b.security_id from bars b join cal c on c.cal_date = b.trade_date and c.prev_open <> c.cal_date
    join bars p on p.security_id = b.security_id and p.trade_date = c.prev_open join master m on m.security_id = b.security_id
    where abs((b.close * b.adj_factor) / nullif(p.close * p.adj_factor, 0) - 1) > 0.21 and b.trade_date <> m.list_date
      and not (b.trade_date >= m.list_date and b.trade_date < m.list_date + cast(case when m.board in ('gem', 'star') then 5 else 1 end as integer))) x
    on x.trade_date = d.trade_date group by 1"""


@query("C22_row_count_rule", "trade_date:d passed:b", _ROW_COUNT, "bars0 master cal")
def _(m):
    return q.row_count(_quality_tables(m), min_universe=15)


@query("C23_adj_continuity_rule", "trade_date:d passed:b", _ADJ, "bars0 bars cal master")
def _(m):
    return q.adj_continuity(_quality_tables(m))


@query("C24_limit_price_rule", "trade_date:d security_id:i mismatch:b", """
    select trade_date, security_id, security_id % 6 = 0 and not (trade_date >= list_date and trade_date < list_date + cast(case when b.board in ('gem', 'star') then 5 else 1 end as integer)) as mismatch
    from lbars b join master using (security_id) where pre_close > 0""", "lbars master")
def _(m):
    t = _quality_tables(m)
    bent = t.bars.withColumn("up_limit", F.col("up_limit") + F.when(F.col("security_id") % 6 == 0, 0.02).otherwise(0.01))
    return q.limit_mismatches(q.Tables(bent, t.master, t.calendar, t.statements, t.factors))


@query("C25_pit_rule", "trade_date:d passed:b", """
    select d.trade_date, count(s.security_id) = 0 as passed from (select distinct trade_date from bars0) d
    left join (select security_id, a from (select *, ann_date - cast(45 as integer) as a from stmt) z where a < report_date) s on s.a = d.trade_date group by 1""", "bars0 stmt")
def _(m):
    t = _quality_tables(m)
    early = t.statements.withColumn("ann_date", F.date_sub("ann_date", 45))
    return q.pit_sanity(q.Tables(t.bars, t.master, t.calendar, early, t.factors))


@query("C26_factor_coverage_rule", "trade_date:d passed:b", """
    select b.trade_date, not coalesce(f.n / b.n::double < 0.5, false) as passed from (select trade_date, count(*) as n from bars0 group by 1) b
    left join (select trade_date, count(*) as n from fac where factor_name = 'mom_20' group by 1) f using (trade_date)""", "bars0 fac")
def _(m):
    return q.factor_coverage(_quality_tables(m))


@query("C27_cross_source", "trade_date:d exchange_code:s side:s differs:b", """
    select trade_date, exchange_code, case when security_id % 2 = 0 then 'both' else 'first_only' end as side, security_id % 2 = 1 or day(trade_date) = 5 as differs
    from bars0 join listing using (security_id)""", "bars0 listing")
def _(m):
    coded = m.raw_bars.join(m.listing.select("security_id", "exchange_code"), "security_id")
    return q.source_differences(coded, _quality_tables(m, m.statements).second_source)


@query("C28_blocked_days", "trade_date:d blocked:b", f"""
    select trade_date, not (r.passed and a.passed) as blocked from ({_ROW_COUNT}) r join ({_ADJ}) a using (trade_date)""", "bars0 bars cal master")
def _(m):
    return q.blocked_days(q.run_all(_quality_tables(m), row_count={"min_universe": 15}))


@query("C29_publication_rows", "dataset:s version:s row_count:i", """
    select 'daily_bar' as dataset, strftime(cal_date, '%Y-%m-%d') as version, (select count(*) from bars0 where trade_date = cal_date) as row_count from cal where is_open = 1
    union all select 'fin_statement', strftime(cal_date, '%Y-%m-%d'), coalesce(n, 0) from cal left join (select ann_date, count(*) as n from stmt group by 1) s on s.ann_date = cal_date where is_open = 1""",
       "cal bars0 stmt")
def _(m):
    return pb.publication_rows({"daily_bar": m.raw_bars, "fin_statement": m.statement_rows}, m.days)


@query("C30_continuity", "expected:i published:i missing:i thin:i ok:b", """
    select count(*) as expected, count(row_count) as published, count(*) - count(row_count) as missing, count(*) filter (where row_count < 12) as thin,
           count(*) = count(row_count) and count(*) filter (where row_count < 12) = 0 as ok
    from (select distinct trade_date from bars0) d left join vers using (trade_date)""", "bars0 vers")
def _(m):
    return pb.continuity_summary(pb.continuity(m.days, m.versions, min_rows=12))


_SMOKE = f"""select b.trade_date, u.chk, case u.chk when 'master' then true when 'bars' then n > 0 when 'published' then day(b.trade_date) % 13 <> 0
    when 'universe' then coalesce(un, 0) >= 15 else coalesce(abs(ws - 1) < 1e-6, true) end as passed
    from (select trade_date, count(*) as n, count(*) filter (where is_suspended <> 1) as un from bars group by 1) b
    left join (select trade_date, sum(weight) as ws from {_TOP} w group by 1) w using (trade_date)
    cross join (select unnest(['master', 'bars', 'published', 'universe', 'weight_sum']) as chk) u"""


def _smoke_rows(m):
    universe = rs.universe(m.bars, m.master, filters=("suspended",))
    return ops.smoke(m.bars, m.listing, m.versions, universe, _top_weights(m), min_universe=15, require_published=True).withColumnRenamed("check", "chk")


@query("C31_smoke_report", "trade_date:d chk:s passed:b", _SMOKE, "bars fac listing")
def _(m):
    return _smoke_rows(m)


@query("C31_release_acceptance", "expected:i missing:i smoke_failed:i accepted:b", f"""
    select (select count(distinct trade_date) from bars0) as expected, (select count(distinct trade_date) from bars0 where day(trade_date) % 13 = 0) as missing,
           (select count(*) from ({_SMOKE}) s where not passed) as smoke_failed, false as accepted""", "bars0 bars fac listing")
def _(m):
    return ops.release(pb.continuity(m.days, m.versions), _smoke_rows(m))


@query("C32_extras_sync", "tab:s trade_date:d n:i", """
    with r as (select least((select max(trade_date) from basic where trade_date < date '2000-03-01'), (select max(suspend_date) from susp where suspend_date < date '2000-06-01')) + 1 as a)
    select 'daily_basic' as tab, trade_date, count(*) as n from basic, r where trade_date between a and date '2001-03-31' group by 1, 2
    union all select 'suspend', suspend_date, count(*) from susp, r where suspend_date between a and date '2001-03-31' group by 1, 2""", "basic susp")
def _(m):
    stored = {"daily_basic": (m.basic.where("trade_date < '2000-03-01'"), "trade_date"), "suspend": (m.suspensions.where("suspend_date < '2000-06-01'"), "suspend_date")}
    _, counts = ops.extras_sync(stored, {"daily_basic": m.basic, "suspend": m.suspensions}, F.lit("2001-03-31").cast("date"))
    return counts.withColumnsRenamed({"table": "tab", "rows": "n"})


@query("C33_backfill_published", "version:s row_count:i", f"""
    select strftime(d.trade_date, '%Y-%m-%d') as version, n as row_count from (select trade_date, count(*) as n from bars0 group by 1) d
    join ({_ROW_COUNT.replace("<= 0.05", "<= 0.5")}) r using (trade_date) join ({_ADJ.replace("> 0.21", "> 6.0")}) a using (trade_date) where day(d.trade_date) % 13 = 0 and r.passed and a.passed""", "bars0 bars cal master")
def _(m):
    t = _quality_tables(m)
    # the invented prices move wildly: with the usual limits no day would ever be published
    return ops.backfill(t.bars, t, m.versions, m.days, row_count={"min_universe": 15, "max_drift": 0.5}, adj_continuity={"max_move": 6.0}).published


@query("C34_health_summary", "security_master:i daily_bar_max:d daily_bar_days:i daily_bar_rows:i latest_published:s last_drift_pct:f8 extras_stale:i", f"""
    select (select count(*) from listing) as security_master, max(trade_date) as daily_bar_max, count(distinct trade_date) as daily_bar_days, count(*) as daily_bar_rows,
           (select max(version) from vers) as latest_published,
           (select (a - b) / b::double from (select count(*) as a from bars0 where trade_date = (select max(trade_date) from bars0)) x,
              (select count(*) as b from bars0 where trade_date = (select max(trade_date) from bars0 where trade_date < (select max(trade_date) from bars0))) y) as last_drift_pct,
           (select count(*) from ({_MARKS}) k where tab in ('daily_basic', 'suspend', 'fin_statement') and (select max(trade_date) from bars0) - max_date > 3) as extras_stale
    from bars0""", "listing bars0 vers basic susp stmt")
def _(m):
    return health.summary(health.watermarks(_marked_tables(m)), health.bar_series(m.raw_bars, 5), m.versions)


@query("C34_extras_lag", "tab:s max_date:d lag_days:i status:s", f"""
    select tab, max_date, lag as lag_days, case when lag <= 0 then 'ok' when lag <= 3 then 'lag' else 'stale' end as status from (
      select tab, max_date, (select max(trade_date) from bars0) - max_date as lag from ({_MARKS}) k where tab in ('daily_basic', 'suspend', 'fin_statement')) z""",
       "listing bars0 basic susp stmt")
def _(m):
    return health.extras_lag(health.watermarks(_marked_tables(m))).withColumnRenamed("table", "tab")


@query("U08_alerts", "id:s level:s source:s", f"""
    select 'health:lag:' || tab as id, 'warn' as level, 'data_health' as source from ({_MARKS}) k
      where tab in ('daily_basic', 'suspend', 'fin_statement') and (select max(trade_date) from bars0) - max_date > 3
    union all select 'health:extras_stale', 'warn', 'data_health'
    union all select 'monitor:' || strftime((select max(trade_date) from bars), '%Y-%m-%d'), 'warn', 'factor_monitor'""", "listing bars0 basic susp stmt bars")
def _(m):
    lag = health.lag_alerts(health.extras_lag(health.watermarks(_marked_tables(m))))
    report = cv.report(cv.coverage(m.factors("mom_20"), m.bars, ["mom_20", "vol_20"]))
    return health.collect_alerts(lag, lag, health.monitor_alerts(report))


@query("C35_extras_alignment", "published_days:i covered:i missing:i first_missing:d last_missing:d ok:b", """
    select count(*) as published_days, count(b.trade_date) as covered, count(*) - count(b.trade_date) as missing, min(v.trade_date) filter (where b.trade_date is null) as first_missing,
           max(v.trade_date) filter (where b.trade_date is null) as last_missing, count(*) = count(b.trade_date) as ok
    from vers v left join (select distinct trade_date from basic where turnover_rate > 4.5) b on b.trade_date = v.trade_date""", "vers basic")
def _(m):
    return pb.alignment_summary(pb.alignment(pb.published_days(m.versions), m.basic.where("turnover_rate > 4.5")))


@query("C35_factor_alignment", "factor_name:s published_overlap:i stored_days:i n:i missing_on_published:i", """
    select n.factor_name, count(v.trade_date) as published_overlap, count(f.trade_date) as stored_days, coalesce(sum(f.k), 0) as n,
           (select count(*) from vers) - count(v.trade_date) as missing_on_published
    from (select unnest(['mom_20', 'mom_60', 'vol_20']) as factor_name) n left join (select factor_name, trade_date, count(*) as k from fac group by 1, 2) f using (factor_name)
    left join vers v on v.trade_date = f.trade_date group by 1""", "fac vers")
def _(m):
    names = ["mom_20", "mom_60", "vol_20"]
    return cv.alignment(m.factors(*names), pb.published_days(m.versions), names).withColumnRenamed("rows", "n")


@query("C35_extras_status", "published_days:i missing:i finance_rows:i finance_codes:i raw_complete:b finance_ok:b overlap_ok:b", """
    select (select count(*) from vers) as published_days, 0 as missing, (select count(*) from stmt) as finance_rows, (select count(distinct security_id) from stmt) as finance_codes,
           raw_complete, raw_complete and (select count(*) from stmt) >= 1 as finance_ok, true as overlap_ok
    from (select count(distinct trade_date) = date_diff('day', min(trade_date), max(trade_date)) + 1 as raw_complete from bars0) c""", "vers stmt bars0")
def _(m):
    landed = m.raw_bars.groupBy(F.col("trade_date").alias("dt")).agg(F.count("*").alias("n"))
    span = m.raw_bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    raw = pb.calendar_coverage(landed, span.select("a").scalar(), span.select("b").scalar())
    return ops.extras_status(pb.published_days(m.versions), m.basic, m.statements, raw, min_rows=1, min_codes=1)


@query("C36_coverage_gate", "trade_date:d n_alerts:i passed:b", f"""
    select trade_date, sum((coverage < 0.9)::int + (n_securities = 0)::int) as n_alerts, sum((coverage < 0.9)::int + (n_securities = 0)::int) = 0 as passed
    from ({_COVERAGE}) c where trade_date = (select max(trade_date) from bars) group by 1""", "bars fac")
def _(m):
    return ops.coverage_gate(cv.report(cv.coverage(m.factors(), m.bars)))


def _plan(m):
    day = m.factors("turn_20").where(F.col("trade_date") == F.lit(DAY)).join(m.listing.select("security_id", "exchange_code"), "security_id")
    weights = wt.target_weights(day, "equal", 10)
    quotes = rs.quotes_of(m.limited_bars, m.listing, DAY)
    held = m.listing.where("security_id % 4 = 0").select("exchange_code", F.lit(300).alias("quantity"))
    return rs.rebalance_plan(weights, quotes, held, total_asset=10_000_000.0, cash=800_000.0)


_PLAN = f"""select exchange_code, side, quantity, case when not lot_ok then 'below_min_lot' when close is null then 'no_price' when is_suspended = 1 then 'suspended'
      when side = 'buy' and close >= up_limit - 1e-6 then 'limit_up' when side = 'sell' and close <= down_limit + 1e-6 then 'limit_down'
      when side = 'buy' and close * 1.0005::double * quantity + greatest(close * 1.0005::double * quantity * 0.0003::double, 5.0) > 800000.0 + 1e-6 then 'cash' end as reason from (
    select l.exchange_code, case when coalesce(t.shares, 0) > coalesce(h.q, 0) then 'buy' else 'sell' end as side, abs(coalesce(t.shares, 0) - coalesce(h.q, 0)) as quantity,
           b.close, b.is_suspended, b.up_limit, b.down_limit, abs(coalesce(t.shares, 0) - coalesce(h.q, 0)) >= case l.board when 'star' then 200 else 100 end as lot_ok
    from listing l left join (select exchange_code, coalesce(cast(floor(floor((10000000.0::double * (1.0::double / count(*) over ())) / close) / 100) * 100 as bigint), 0) as shares from (
        select l.exchange_code, b.close from fac f join listing l using (security_id) left join lbars b on b.security_id = f.security_id and b.trade_date = f.trade_date
        where factor_name = 'turn_20' and f.trade_date = {D} order by value desc, l.exchange_code limit 10) x) t on t.exchange_code = l.exchange_code
    left join (select exchange_code, 300 as q from listing where security_id % 4 = 0) h on h.exchange_code = l.exchange_code
    left join lbars b on b.security_id = l.security_id and b.trade_date = {D} where coalesce(t.shares, 0) <> coalesce(h.q, 0)) z"""


@query("C37_rebalance_orders", "exchange_code:s side:s quantity:i", f"select * from ({_PLAN}) p where reason is null", "fac listing lbars")
def _(m):
    return _plan(m)[0]


@query("C37_rebalance_rejects", "exchange_code:s side:s quantity:i reason:s", f"select * from ({_PLAN}) p where reason is not null", "fac listing lbars")
def _(m):
    return _plan(m)[1].withColumn("reason", F.element_at("reasons", -1))


@query("C38_items_of_securities", "exchange_code:s item:s value:f2", f"""
    with s as (select * from stmt where ann_date <= {D})
    select l.exchange_code, item, value from listing l join (
      select security_id, 'net_profit' as item, arg_max(net_profit, row(report_date, ann_date, update_flag)) as value from s group by 1
      union all select security_id, 'equity', arg_max(equity, row(report_date, ann_date, update_flag)) from s group by 1
      union all select security_id, 'revenue', arg_max(revenue, row(report_date, ann_date, update_flag)) from s group by 1) v using (security_id)""", "stmt listing")
def _(m):
    items = asof.visible_items(m.statements, ["net_profit", "equity", "revenue"], DAY)
    return items.join(m.listing.select("security_id", "exchange_code"), "security_id")


@query("C38_fundamental_read", "exchange_code:s value:f2", f"""
    select l.exchange_code, arg_max(revenue, row(report_date, ann_date, update_flag)) as value from stmt join listing l using (security_id) where ann_date <= {D} group by 1""", "stmt listing")
def _(m):
    return rs.get_fundamental(m.statements, m.listing, "revenue", dt.date(2000, 1, 1), version="1999-06-30")


@query("C38_sql_table_functions", "security_id:i exchange_code:s industry:s post_close:f6 last_day:d net_profit:f2", f"""
    with day as (select date '1997-06-30' as d),
    item as (select security_id, arg_max(net_profit, row(report_date, ann_date, update_flag)) as net_profit from stmt, day where ann_date <= d group by 1)
    select x.security_id, x.exchange_code, i.industry, b.close * b.adj_factor as post_close, z.last_day, item.net_profit
    from members x join day on x.in_date <= d and x.out_date > d
    left join inds i on i.security_id = x.security_id and i.in_date <= d and i.out_date > d
    left join bars b on b.security_id = x.security_id and b.trade_date = d
    left join (select security_id, max(trade_date) as last_day from bars0, day where trade_date <= d group by 1) z on z.security_id = x.security_id
    left join item on item.security_id = x.security_id""", "members inds bars bars0 stmt")
def _(m):
    from barloom.sources import pit_sql

    pit_sql.register(m.spark, bars=m.bars, master=m.master, members=m.members.join(m.listing.select("security_id", "exchange_code"), "security_id"),
                     industries=m.industries, statements=m.statements)
    return m.spark.sql("""
        SELECT m.security_id, m.exchange_code, i.industry, p.post_close, l.trade_date AS last_day, v.value AS net_profit
        FROM members_on('IDX_A', DATE '1997-06-30') m
        LEFT JOIN industry_on('sw_l1', DATE '1997-06-30') i ON i.security_id = m.security_id
        LEFT JOIN price_on(DATE '1997-06-30') p ON p.security_id = m.security_id
        LEFT JOIN last_price_by(DATE '1997-06-30') l ON l.security_id = m.security_id
        LEFT JOIN visible_item('net_profit', DATE '1997-06-30') v ON v.security_id = m.security_id""")


@query("C06_universe_by_sql", "security_id:i exchange_code:s", """
    select x.security_id, x.exchange_code from members x join bars b on b.security_id = x.security_id and b.trade_date = date '1997-06-30' join master l on l.security_id = x.security_id
    where x.in_date <= b.trade_date and x.out_date > b.trade_date and b.is_suspended <> 1 and b.is_st <> 1 and l.list_date <= b.trade_date - 120""", "members bars master")
def _(m):
    from barloom.sources import pit_sql

    pit_sql.register(m.spark, bars=m.bars, master=m.master, members=m.members.join(m.listing.select("security_id", "exchange_code"), "security_id"),
                     industries=m.industries, statements=m.statements)
    return m.spark.sql("SELECT * FROM universe_on('IDX_A', DATE '1997-06-30', 120)")


@query("C39_overview", "version:s max_date:d n:i n_codes:i monitored:d n_alerts:i session_id:s", """
    select (select max(version) from vers) as version, max(trade_date) as max_date, count(*) as n, count(distinct security_id) as n_codes, max(trade_date) as monitored,
           (select sum((coalesce(k, 0) / u::double < 0.9)::int + (coalesce(k, 0) = 0)::int) from (select count(*) filter (where is_suspended = 0) as u from bars where trade_date = (select max(trade_date) from bars)) a,
              (select count(*) as k from fac where factor_name = 'mom_20' and trade_date = (select max(trade_date) from bars)) b) as n_alerts,
           (select max(board) from listing) as session_id from bars0""", "vers bars0 bars fac listing")
def _(m):
    report = cv.report(cv.coverage(m.factors("mom_20"), m.bars, ["mom_20"]))
    sessions = m.listing.select(F.col("board").alias("session_id"), F.col("board").alias("created_at")).distinct().select(
        "*", F.lit(1.0).alias("total_asset"), F.lit(1.0).alias("cash"))
    marks = sessions.select("session_id", F.lit(DAY).alias("mark_date"), F.lit(0.0).alias("pnl_vs_initial"))
    out = health.overview(m.versions, m.raw_bars, report, sessions, marks)
    return out.select("version", F.col("daily_bar.max_date").alias("max_date"), F.col("daily_bar.rows").alias("n"), F.col("daily_bar.n_codes").alias("n_codes"),
                      F.col("factor_monitor.trade_date").alias("monitored"), F.col("factor_monitor.n_alerts").alias("n_alerts"), F.col("paper.session_id").alias("session_id"))


@query("C40_execution_frame", "security_id:i trade_date:d open:f close:f up_limit:f suspended:b volume:f mark:f", "select * from exec", "exec")
def _(m):
    return m.execution


@query("C41_research_acceptance", "n_ok:i n_fail:i published_days:i signal_names:i judgment_ok:i passed:b", f"""
    select 3 as n_ok, 1 as n_fail, (select count(*) from vers) as published_days,
      (select least(10, count(*)) from fac where factor_name = 'turn_20' and trade_date = {D}) as signal_names,
      (select count(*) from ({_CARDS}) c where comp is not null) as judgment_ok, false as passed""", _CARD_VIEWS + " vers")
def _(m):
    m = m.stored("statement_rows", "industries", "calendar")
    panel = rs.panel(m.limited_bars, m.factors("mom_20"), m.master, rs.Spec(methods=_METHODS, top_n=10, factors=("mom_20",)), industry=m.industries)
    weights = rs.weight_series(panel, rs.Spec(methods=_METHODS, top_n=10, factors=("mom_20",)))
    done = rs.experiment(weights, m.bars, m.execution, m.calendar).select("factor_name", "weight_method", "status")
    grid = rs.cells(["mom_20"], [*_METHODS, "unheard_of"], m.spark)
    day = m.factors("turn_20").where(F.col("trade_date") == F.lit(DAY)).join(m.listing.select("security_id", "exchange_code"), "security_id")
    return ops.acceptance(pb.published_days(m.versions), rs.with_failed_cells(grid, done), wt.target_weights(day, "equal", 10), _cards(m))


