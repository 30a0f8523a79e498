"""Joins, selection, sets and ordering (J, L, U rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.operators import asof, calendar as cal, coverage as cv, health, judgment as jd, orders as od, performance as pf
from barloom.operators import prices as pr, publish as pb, ranking, weights as wt
from barloom.plans import build, research as rs
from barloom.sources import tables as tb
from suite.base import query


def _priced(m):
    """Bars with board, split into two landed halves by security parity."""
    return m.raw_bars.join(m.listing.select("security_id", "exchange_code", "board"), "security_id")


@query("J01_bars_with_master", "trade_date:d exchange_code:s close:f",
       "select trade_date, exchange_code, close from bars0 join master using (security_id)", "bars0 master")
def _(m):
    return m.raw_bars.join(m.master, "security_id")


@query("J02_factor_with_codes", "trade_date:d security_id:i exchange_code:s value:f8", """
    select trade_date, f.security_id, l.exchange_code, value from fac f left join (select * from listing where security_id % 10 <> 0) l using (security_id)
    where factor_name = 'mom_20'""", "fac listing")
def _(m):
    return rs.get_factor(m.factors("mom_20"), m.listing.where("security_id % 10 <> 0"), "mom_20")


@query("J03_members_with_or_without_bar", "trade_date:d exchange_code:s", """
    select c.cal_date as trade_date, x.exchange_code from cal c join members x on x.in_date <= c.cal_date and x.out_date > c.cal_date
    left join bars b on b.security_id = x.security_id and b.trade_date = c.cal_date
    where c.is_open = 1 and coalesce(b.is_suspended, 0) <> 1""", "cal members bars")
def _(m):
    return rs.universe(m.bars, m.master, index_code="IDX_A", members=m.members, calendar=m.calendar, filters=("suspended",))


@query("J10_map_ids", "kind:s trade_date:d exchange_code:s security_id:i", """
    select case when l.security_id is null then 'rejected' else 'kept' end as kind, trade_date, x.exchange_code, l.security_id
    from (select b.trade_date, l.exchange_code from bars0 b join listing l using (security_id)) x
    left join (select * from listing where security_id % 7 <> 0) l using (exchange_code)""", "bars0 listing")
def _(m):
    kept, rejected = asof.map_ids(_priced(m).select("trade_date", "exchange_code"), m.listing.where("security_id % 7 <> 0"))
    return kept.withColumn("kind", F.lit("kept")).unionByName(rejected.withColumn("kind", F.lit("rejected")), allowMissingColumns=True)


@query("J11_bars_with_factor", "security_id:i trade_date:d adj_factor:f", """
    select security_id, trade_date, case when security_id % 5 = 0 then 1.0 else adj_factor end as adj_factor from bars""", "bars")
def _(m):
    coded = m.bars.drop("is_suspended", "is_st").join(m.listing.select("security_id", "exchange_code"), "security_id")
    landed = coded.select("exchange_code", "trade_date", "adj_factor").where("security_id % 5 <> 0")
    rows, _ = build.daily_bars(coded.drop("adj_factor", "security_id"), landed.unionByName(landed),
                               coded.select("exchange_code", F.col("trade_date").alias("suspend_date")).limit(0), m.master)
    return rows


@query("J12_suspended_by_membership", "security_id:i trade_date:d suspended:i", """
    select security_id, trade_date, case when (security_id + day(trade_date)) % 31 = 0 then 1 else 0 end as suspended from bars0""", "bars0")
def _(m):
    return pr.suspended_either(m.raw_bars.withColumn("is_suspended", F.lit(0)), m.suspensions.unionByName(m.suspensions))


@query("J13_suspended_either_source", "security_id:i trade_date:d suspended:i", """
    select security_id, trade_date, case when is_suspended = 1 or (security_id + day(trade_date)) % 31 = 0 then 1 else 0 end as suspended from bars""", "bars")
def _(m):
    return pr.suspended_either(m.bars, m.suspensions)


@query("J14_factor_with_next_close", "security_id:i trade_date:d fwd_date:d value:f8 fwd_ret:f8", """
    select f.security_id, f.trade_date, c.next_open as fwd_date, f.value, b1.close / b0.close - 1 as fwd_ret from fac f
    join cal c on c.cal_date = f.trade_date join bars0 b0 on b0.security_id = f.security_id and b0.trade_date = f.trade_date
    join bars0 b1 on b1.security_id = f.security_id and b1.trade_date = c.next_open
    where factor_name = 'mom_20' and c.next_open <> c.cal_date""", "fac cal bars0")
def _(m):
    px = m.raw_bars.select("security_id", "trade_date", "close")
    now = cal.link(px, m.calendar, "next_open", "fwd_date")
    nxt = px.select("security_id", F.col("trade_date").alias("fwd_date"), F.col("close").alias("c1"))
    fwd = now.join(nxt, ["security_id", "fwd_date"]).withColumn("fwd_ret", F.col("c1") / F.col("close") - 1)
    return m.factors("mom_20").join(fwd, ["security_id", "trade_date"])


@query("J15_exposure_full_join", "trade_date:d industry:s signal_weight:f8 index_weight:f8 diff:f8", """
    select trade_date, industry, coalesce(s, 0) as signal_weight, coalesce(i, 0) as index_weight, coalesce(s, 0) - coalesce(i, 0) as diff from (
      select trade_date, board as industry, sum(volume / t) as s from (
        select *, sum(volume) over (partition by trade_date) as t from bars0 join listing using (security_id) where board <> 'bse') a group by 1, 2) x
    full join (select trade_date, industry, n / sum(n) over (partition by trade_date) as i from (
        select trade_date, board as industry, count(*) as n from bars0 join listing using (security_id) where board <> 'main' group by 1, 2) b) y
    using (trade_date, industry)""", "bars0 listing")
def _(m):
    rows = _priced(m).withColumnRenamed("board", "industry")
    sig = rows.where("industry <> 'bse'")
    total = sig.groupBy("trade_date").agg(F.sum("volume").alias("t"))
    sig = sig.join(total, "trade_date").withColumn("weight", F.col("volume") / F.col("t"))
    return wt.exposure(sig, rows.where("industry <> 'main'"))


@query("J16_order_difference", "trade_date:d exchange_code:s side:s quantity:i", """
    select trade_date, exchange_code, case when d > 0 then 'buy' else 'sell' end as side, abs(d) as quantity from (
      select trade_date, exchange_code, case when security_id % 3 = 0 then 0 else volume end - case when security_id % 2 = 0 then 0 else 2000 end as d
      from bars0 join listing using (security_id)) z where d <> 0""", "bars0 listing")
def _(m):
    rows = _priced(m)
    have = rows.where("security_id % 2 <> 0").select("trade_date", "exchange_code", F.lit(2000).alias("quantity"))
    want = rows.where("security_id % 3 <> 0").select("trade_date", "exchange_code", F.col("volume").alias("target"))
    return od.difference(have, want, ["trade_date"])


@query("J17_two_curves", "trade_date:d nav_a:f4 nav_b:f4", """
    with d as (select board, trade_date, sum(volume)::double as nav from bars0 join listing using (security_id) group by 1, 2),
    a as (select trade_date, nav / first_value(nav) over (order by trade_date) as nav_a from d where board = 'main' and day(trade_date) % 2 = 0),
    b as (select trade_date, nav / first_value(nav) over (order by trade_date) as nav_b from d where board = 'gem' and day(trade_date) % 3 = 0)
    select trade_date, nav_a, nav_b from a full join b using (trade_date)""", "bars0 listing")
def _(m):
    nav = _priced(m).groupBy("board", "trade_date").agg(F.sum("volume").cast("double").alias("nav"))
    return pf.compare(nav.where("board = 'main' and day(trade_date) % 2 = 0").drop("board"),
                      nav.where("board = 'gem' and day(trade_date) % 3 = 0").drop("board"))


_PANEL_SQL = """select f.trade_date, l.exchange_code, f.security_id, f.factor_name, b.close * b.adj_factor as close, f.value, coalesce(i.industry, 'UNKNOWN') as industry
    from fac f join bars b on b.security_id = f.security_id and b.trade_date = f.trade_date join master l on l.security_id = f.security_id
    left join inds i on i.security_id = f.security_id and i.in_date <= f.trade_date and i.out_date > f.trade_date
    where b.is_st <> 1 and b.is_suspended <> 1 and l.list_date <= b.trade_date - 120"""


@query("J18_day_panel", "trade_date:d exchange_code:s close:f value:f8 industry:s", f"""
    select * from ({_PANEL_SQL}) p where factor_name = 'mom_20' and exists
      (select 1 from members x where x.security_id = p.security_id and x.in_date <= p.trade_date and x.out_date > p.trade_date)""",
       "fac bars master inds members")
def _(m):
    return rs.panel(m.limited_bars, m.factors("mom_20"), m.master, rs.Spec(universe="IDX_A"), members=m.members, industry=m.industries)


@query("J19_named_positions", "exchange_code:s name:s", """
    select exchange_code, case when security_id % 4 = 0 then 'kept ' || exchange_code when security_id % 10 = 1 then '—' else name end as name from listing""", "listing")
def _(m):
    known = m.master.where("security_id % 10 <> 1 or security_id % 4 = 0")
    k = F.col("security_id") % 4
    own = F.when(k == 0, F.concat(F.lit("kept "), F.col("exchange_code"))).when(k == 1, F.col("exchange_code")).when(k == 2, " ")
    return od.named(m.listing.select("exchange_code", own.alias("name")), known)


@query("J20_parameter_grid", "factor_name:s weight_method:s", """
    select factor_name, weight_method from (select distinct factor_name from fac) f
    cross join (select unnest(['equal', 'factor_rank', 'industry_neutral']) as weight_method) w""", "fac")
def _(m):
    names = m.factors().select("factor_name").distinct()
    return names.select("factor_name", F.explode(F.array(*[F.lit(x) for x in ("equal", "factor_rank", "industry_neutral")])).alias("weight_method"))


@query("J21_item_coverage", "item:s n_hit:i sample:i coverage:f8", """
    with u as (select distinct security_id from bars0 where trade_date = (select max(trade_date) from bars0)),
    s as (select * from stmt where ann_date <= (select max(trade_date) from bars0) and security_id in (select security_id from u))
    select item, n_hit, sample, n_hit / sample::double as coverage from (
      select 'net_profit' as item, (select count(distinct security_id) from s) as n_hit, (select count(*) from u) as sample
      union all select 'equity', (select count(distinct security_id) from s), (select count(*) from u)
      union all select 'op_profit', 0, (select count(*) from u)) z""", "bars0 stmt")
def _(m):
    last = m.raw_bars.agg(F.max("trade_date")).scalar()
    return health.item_coverage(m.statements, m.raw_bars, last, ("net_profit", "equity", "op_profit"))


@query("J22_universe_with_listing", "exchange_code:s symbol:s name:s list_date:d", """
    select exchange_code, substr(exchange_code, 1, 6) as symbol, case when security_id % 6 = 0 then exchange_code else name end as name,
           case when security_id % 6 = 0 then null else list_date end as list_date
    from master where security_id in (select security_id from bars0)""", "master bars0")
def _(m):
    return build.listing_for_universe(_priced(m), m.master.where("security_id % 6 <> 0"))


# ---- order, limit, top-n ---------------------------------------------------------------


@query("L01_ordered_prices", "exchange_code:s trade_date:d close:f", "select exchange_code, trade_date, close from bars0 join listing using (security_id)", "bars0 listing")
def _(m):
    return _priced(m).orderBy("exchange_code", "trade_date")


@query("L02_latest_dates", "trade_date:d", "select distinct trade_date from fac where factor_name = 'vol_20' order by 1 desc limit 60", "fac")
def _(m):
    return cv.dates(m.factors("vol_20"), "vol_20", 60)


@query("L03_last_rows_per_code", "security_id:i trade_date:d close:f", """
    select security_id, trade_date, close from bars0 qualify row_number() over (partition by security_id order by trade_date desc) <= 5""", "bars0")
def _(m):
    return jd.last_rows(m.raw_bars, "security_id", 5)


@query("L03_latest_quote", "exchange_code:s price:f pre_close:f up_limit:f", """
    select exchange_code, close as price, pre_close, up_limit from lbars qualify row_number() over (partition by security_id order by trade_date desc) = 1""", "lbars")
def _(m):
    return rs.quotes_of(m.limited_bars, m.listing)


@query("L04_top_names", "trade_date:d exchange_code:s value:f8", """
    select f.trade_date, exchange_code, value from fac f join listing using (security_id) where factor_name = 'turn_20'
    qualify row_number() over (partition by f.trade_date order by value desc, exchange_code) <= 5""", "fac listing")
def _(m):
    panel = m.factors("turn_20").join(m.listing.select("security_id", "exchange_code"), "security_id")
    return wt.select_names(panel, ["trade_date"], 5)


@query("L05_hash_sample", "trade_date:d security_id:i", """
    select trade_date, security_id from bars0
    qualify row_number() over (partition by trade_date order by md5(security_id || '|' || strftime(trade_date, '%Y-%m-%d')), security_id) <= 12""", "bars0")
def _(m):
    key = F.md5(F.concat_ws("|", F.col("security_id").cast("string"), F.date_format("trade_date", "yyyy-MM-dd")))
    return ranking.top_n(m.raw_bars, ["trade_date"], [key, F.col("security_id")], 12)


@query("L06_best_cell", "board:s year:i sharpe:f6", """
    select board, year, sharpe from (
      select board, year(trade_date) as year, case when board = 'bse' then null else avg(volume) / nullif(stddev_samp(volume), 0) end as sharpe, board = 'main' as bad
      from bars0 join listing using (security_id) group by 1, 2) z where not bad order by sharpe desc nulls last, board limit 1""", "bars0 listing")
def _(m):
    cells = _priced(m).groupBy("board", F.year("trade_date").alias("year")).agg(
        F.try_divide(F.avg("volume"), F.nullif(F.stddev_samp("volume"), F.lit(0.0))).alias("x")
    ).select("board", "year", F.when(F.col("board") != "bse", F.col("x")).alias("sharpe"),
             F.when(F.col("board") == "main", "fail").otherwise("ok").alias("status"), F.col("board").alias("factor_name"))
    return rs.best_cell(cells)


@query("L07_latest_basic", "security_id:i trade_date:d total_mv:f turnover_rate:f", """
    select security_id, trade_date, total_mv, turnover_rate from basic where trade_date <= date '1999-06-30'
    qualify row_number() over (partition by security_id order by trade_date desc) = 1""", "basic")
def _(m):
    return rs.latest_basic(m.basic, upto=dt.date(1999, 6, 30))


@query("L08_default_range", "start:d finish:d", """
    select greatest(min(trade_date), max(trade_date) - 90) as start, max(trade_date) as finish from bars0""", "bars0")
def _(m):
    return rs.default_range(m.raw_bars).withColumnRenamed("end", "finish")


@query("L09_recent_publications", "dataset:s version:s row_count:i", "select dataset, version, row_count from vers order by version desc limit 20", "vers")
def _(m):
    return pb.recent(m.versions)


@query("L11_paging", "exchange_code:s trade_date:d", """
    select exchange_code, trade_date from bars0 join listing using (security_id) order by exchange_code, trade_date offset 300 limit 100""", "bars0 listing")
def _(m):
    rows, keys, last = _priced(m), ["exchange_code", "trade_date"], None
    for _ in range(3):  # the key each page ends with leads to the next
        last = ranking.last_key(ranking.page_after(rows, keys, 100, last), keys)
    return ranking.page_after(rows, keys, 100, last)


# ---- sets and de-duplication -------------------------------------------------------------


@query("U01_union_of_parts", "security_id:i ann_date:d stmt_type:s keys:s", """
    select security_id, ann_date, 'income' as stmt_type, 'net_profit,revenue' as keys from stmt
    union all select security_id, ann_date, 'balance', 'equity' from stmt""", "stmt")
def _(m):
    rows = m.statement_rows.join(m.listing.select("security_id", "exchange_code"), "security_id").drop("security_id")
    parts = {"income": rows.select("exchange_code", "ann_date", "report_date", "update_flag", "revenue", F.col("net_profit").alias("n_income_attr_p")),
             "balancesheet": rows.select("exchange_code", "ann_date", "report_date", F.col("equity").alias("total_hldr_eqy_exc_min_int"))}
    return build.statements(parts, m.listing).withColumn("keys", F.array_join(F.array_sort(F.map_keys("fields")), ","))


@query("U02_missing_days", "trade_date:d", "select distinct trade_date from bars0 where day(trade_date) % 13 = 0", "bars0")
def _(m):
    return pb.unpublished(m.days, m.versions)


@query("U02_missing_factor_days", "factor_name:s trade_date:d", """
    select n.factor_name, d.trade_date from (select distinct trade_date from vers) d cross join (select unnest(['mom_20', 'mom_60', 'vol_20']) as factor_name) n
    where not exists (select 1 from fac f where f.factor_name = n.factor_name and f.trade_date = d.trade_date)""", "vers fac")
def _(m):
    names = ["mom_20", "mom_60", "vol_20"]
    return cv.missing_days(m.factors(*names), pb.published_days(m.versions), names)


@query("U03_overlap", "trade_date:d", """
    select trade_date from vers where trade_date in (select trade_date from basic where turnover_rate > 4)""", "vers basic")
def _(m):
    return pb.alignment(pb.published_days(m.versions), m.basic.where("turnover_rate > 4")).where("present")


@query("U03_reconciled_rows", "security_id:i trade_date:d volume:i side:s n:i", """
    with landed as (select security_id, trade_date, volume from bars0 union all select security_id, trade_date, volume from bars0 where day(trade_date) = 7),
    stored as (select security_id, trade_date, volume + case when security_id % 11 = 0 and day(trade_date) = 9 then 1 else 0 end as volume from bars0
      union all select security_id, trade_date, volume from bars0 where day(trade_date) = 8),
    counts as (select security_id, trade_date, volume, sum(k) as k from (select *, 1 as k from landed union all select *, -1 from stored) z group by 1, 2, 3)
    select security_id, trade_date, volume, case when k > 0 then 'landed' else 'stored' end as side, abs(k) as n from counts where k <> 0""", "bars0")
def _(m):
    rows = m.raw_bars.select("security_id", "trade_date", "volume")
    day = F.dayofmonth("trade_date")
    bent = F.when((F.col("security_id") % 11 == 0) & (day == 9), 1).otherwise(0)
    return pb.reconcile(rows.unionByName(rows.where(day == 7)), rows.withColumn("volume", F.col("volume") + bent).unionByName(rows.where(day == 8)))


@query("U03_rows_in_both", "security_id:i month:d n:i", """
    select security_id, month, least(a, b) as n from (
      select security_id, cast(date_trunc('month', trade_date) as date) as month, count(*) as a, count(*) filter (where close > open) as b from bars0 group by 1, 2) z where least(a, b) > 0""", "bars0")
def _(m):
    rows = m.raw_bars.select("security_id", F.trunc("trade_date", "month").alias("month"), "open", "close")
    return pb.in_both(rows.select("security_id", "month"), rows.where("close > open").select("security_id", "month"))


@query("U04_thin_days", "trade_date:d row_count:i", "select trade_date, row_count from vers where row_count < 20", "vers")
def _(m):
    return pb.continuity(m.days, m.versions, min_rows=20).where("state = 'thin'")


@query("U05_days_missing_any_factor", "trade_date:d", """
    select distinct d.trade_date from vers d cross join (select unnest(['mom_20', 'mom_60', 'vol_20']) as factor_name) n
    where not exists (select 1 from fac f where f.factor_name = n.factor_name and f.trade_date = d.trade_date)""", "vers fac")
def _(m):
    names = ["mom_20", "mom_60", "vol_20"]
    return cv.missing_days(m.factors(*names), pb.published_days(m.versions), names).select("trade_date").distinct()


@query("U06_keep_last", "security_id:i month:d trade_date:d close:f", """
    select security_id, cast(date_trunc('month', trade_date) as date) as month, trade_date, close from bars0
    qualify row_number() over (partition by security_id, date_trunc('month', trade_date) order by trade_date desc) = 1""", "bars0")
def _(m):
    return tb.keep_last(m.raw_bars.withColumn("month", F.trunc("trade_date", "month")), ["security_id", "month"], ["trade_date"])


@query("U07_distinct_suspensions", "security_id:i suspend_date:d resume_date:d", """
    select s.security_id, s.suspend_date, (select min(trade_date) from bars0 b where b.security_id = s.security_id and b.trade_date > s.suspend_date and volume > 0) as resume_date
    from (select distinct * from susp) s""", "susp bars0")
def _(m):
    coded = m.suspensions.join(m.listing.select("security_id", "exchange_code"), "security_id").drop("security_id")
    rows = build.suspensions(coded.unionByName(coded), m.listing)
    return pr.with_resume_date(rows, m.raw_bars)


@query("U09_calendar_coverage", "expected_days:i present_days:i missing_days:i complete:b", """
    select count(*) as expected_days, count(*) filter (where is_open = 1) as present_days, count(*) filter (where is_open = 0) as missing_days,
           count(*) filter (where is_open = 0) = 0 as complete from cal""", "cal")
def _(m):
    landed = m.raw_bars.groupBy(F.col("trade_date").alias("dt")).agg(F.count_if(F.col("security_id") < 0).alias("n"))
    span = m.raw_bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    return pb.calendar_coverage(landed, span.select("a").scalar(), span.select("b").scalar())


_SEGMENTS = """select year(d.trade_date) || 'Q' || quarter(d.trade_date) as segment, min(d.trade_date) as start, max(d.trade_date) as finish, count(*) as expected,
    count(v.row_count) as published, count(*) - count(v.row_count) as missing, count(*) filter (where v.row_count < 12) as thin,
    count(*) = count(v.row_count) and count(*) filter (where v.row_count < 12) = 0 as ok
    from (select distinct trade_date from bars0) d left join vers v using (trade_date) group by 1"""


@query("U10_segments", "segment:s start:d finish:d expected:i published:i missing:i thin:i ok:b", _SEGMENTS, "bars0 vers")
def _(m):
    states = pb.continuity(m.days, m.versions, min_rows=12)
    return pb.segments(states, pb.quarter_label(F.col("trade_date"))).withColumnRenamed("end", "finish")


@query("U10_first_gap", "segment:s", f"select segment from ({_SEGMENTS}) z where not ok order by start limit 1", "bars0 vers")
def _(m):
    states = pb.continuity(m.days, m.versions, min_rows=12)
    return pb.first_gap(pb.segments(states, pb.quarter_label(F.col("trade_date"))))


@query("U11_merged_listing", "exchange_code:s name:s source_status:s", """
    select exchange_code, name, case when security_id % 2 = 0 then 'L' when security_id % 3 = 0 then 'D' else 'P' end as source_status from listing""", "listing")
def _(m):
    rows = m.listing.select("exchange_code", "name", "security_id")
    parts = [rows.where(c).withColumn("source_status", F.lit(s)) for c, s in (("security_id % 2 = 0", "L"), ("security_id % 3 = 0", "D"), ("true", "P"))]
    return build.merged_listing(*parts)


