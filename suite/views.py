"""SQL (DuckDB) definitions of the market-shaped views, used only to check results."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {
    # name -> (views it reads, body)
    "px": ("", """
        select l_suppkey as security_id, cast(l_shipdate as date) as trade_date, l_orderkey, l_linenumber,
               l_quantity, l_extendedprice, l_discount, l_partkey, l_extendedprice / l_quantity as p
        from lineitem"""),
    "bars0": ("px", """
        select security_id, trade_date,
               arg_min(p, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) as open, max(p) as high, min(p) as low,
               arg_max(p, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) as close,
               cast(sum(l_quantity) * 100 as bigint) as volume,
               cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount
        from px group by 1, 2"""),
    "listing": ("", """
        select s_suppkey as security_id,
               case s_nationkey % 4 when 0 then '600' when 1 then '300' when 2 then '688' else '830' end
                 || case when length(cast(s_suppkey as varchar)) < 3 then lpad(cast(s_suppkey as varchar), 3, '0') else cast(s_suppkey as varchar) end
                 || case s_nationkey % 4 when 1 then '.SZ' when 3 then '.BJ' else '.SH' end as exchange_code,
               case when s_acctbal < 0 then 'ST ' else '' end || s_name as name,
               case s_nationkey % 4 when 0 then 'main' when 1 then 'gem' when 2 then 'star' else 'bse' end as board,
               case when s_acctbal < 0 then 1 else 0 end as is_st
        from supplier"""),
    "master": ("listing px", """
        select l.*, m.list_date, cast(null as date) as delist_date, m.list_date as valid_from, date '2099-12-31' as valid_to
        from listing l left join (select security_id, min(trade_date) as list_date from px group by 1) m using (security_id)"""),
    "bars": ("bars0 listing", """
        select b.*, coalesce(lag(close) over (partition by b.security_id order by trade_date), close) as pre_close,
               1.0 + 0.05 * (year(trade_date) - 1995) as adj_factor,
               case when (b.security_id + day(trade_date)) % 29 = 0 then 1 else 0 end as is_suspended, m.is_st
        from bars0 b join listing m using (security_id)"""),
    "lbars": ("bars listing", """
        select b.*, l.board, l.exchange_code,
               round(b.pre_close * (1 + pct) + 1e-9, 2) as up_limit, round(b.pre_close * (1 - pct) + 1e-9, 2) as down_limit
        from bars b join (select *, cast(case when is_st = 1 and board = 'main' then 0.05 when board = 'main' then 0.10
                                         when board = 'bse' then 0.30 else 0.20 end as double) as pct from listing) l using (security_id)"""),
    "basic": ("bars0", """
        select security_id, trade_date, close * (1000 + security_id) / 10.0 as total_mv,
               case when (security_id + day(trade_date)) % 17 = 0 then null else volume / 1024.0 end as turnover_rate
        from bars0"""),
    "cal": ("bars0", """
        select cal_date, is_open,
               coalesce(last_value(case when is_open = 1 then cal_date end ignore nulls) over
                 (order by cal_date rows between unbounded preceding and 1 preceding), cal_date) as prev_open,
               coalesce(first_value(case when is_open = 1 then cal_date end ignore nulls) over
                 (order by cal_date rows between 1 following and unbounded following), cal_date) as next_open
        from (select cast(d as date) as cal_date, case when o.trade_date is null then 0 else 1 end as is_open
              from (select unnest(generate_series(a, b, interval 1 day)) as d
                    from (select min(trade_date) as a, max(trade_date) as b from bars0)) s
              left join (select distinct trade_date from bars0) o on o.trade_date = cast(s.d as date)) c"""),
    "index_snap": ("bars0 listing", """
        select 'IDX_A' as index_code, m.exchange_code, m.security_id, cast(date_trunc('month', trade_date) as date) as as_of_date
        from bars0 join listing m using (security_id) group by 1, 2, 3, 4 having count(*) >= 6"""),
    "industry_snap": ("px listing", """
        select exchange_code, security_id, 'sw_l1' as level, industry, as_of_date from (
          select m.exchange_code, px.security_id, p_brand as industry, cast(date_trunc('quarter', trade_date) as date) as as_of_date,
                 row_number() over (partition by m.exchange_code, date_trunc('quarter', trade_date) order by count(*) desc, p_brand) rn
          from px join part on p_partkey = l_partkey join listing m using (security_id)
          group by 1, 2, 3, 4, date_trunc('quarter', trade_date)) z where rn = 1"""),
    "members": ("index_snap", """
        select index_code, security_id, exchange_code, min(as_of_date) as in_date,
               case when count(nxt) < count(*) then date '2099-12-31' else max(nxt) end as out_date
        from (select s.*, d.nxt, d.ord - row_number() over (partition by s.index_code, s.exchange_code order by s.as_of_date) as g
              from index_snap s join (
                select index_code, as_of_date, row_number() over (partition by index_code order by as_of_date) as ord,
                       lead(as_of_date) over (partition by index_code order by as_of_date) as nxt
                from (select distinct index_code, as_of_date from index_snap) u) d using (index_code, as_of_date)) i
        group by index_code, security_id, exchange_code, g"""),
    "inds": ("industry_snap", """
        select security_id, exchange_code, level, industry, as_of_date as in_date,
               coalesce(lead(as_of_date) over (partition by exchange_code, level order by as_of_date), date '2099-12-31') as out_date
        from (select *, lag(industry) over (partition by exchange_code, level order by as_of_date) as before from industry_snap) z
        where before is null or before <> industry"""),
    "stmt": ("px", """
        with q as (select security_id, cast(date_trunc('quarter', trade_date) + interval 3 month - interval 1 day as date) as report_date,
                          cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as rev,
                          cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) * 0.1 as np
                   from px group by 1, 2)
        select security_id, report_date, report_date + cast(20 + (security_id * 7 + month(report_date)) % 60 as integer) as ann_date,
               0 as update_flag, rev as revenue, np as net_profit, rev * 3 as equity from q
        union all
        select security_id, report_date, report_date + cast(65 + (security_id * 7 + month(report_date)) % 60 as integer), 1,
               rev * 0.9, np * 0.9, rev * 3 * 0.9 from q where (security_id + quarter(report_date)) % 5 = 0"""),
    "susp": ("bars0", """
        select security_id, trade_date as suspend_date from bars0 where (security_id + day(trade_date)) % 31 = 0"""),
    "names": ("bars0 listing", """
        with seen as (select security_id, exchange_code, cast(date_trunc('month', trade_date) as date) as as_of_date, count(*) as n
                      from bars0 join listing using (security_id) group by 1, 2, 3)
        select security_id, exchange_code, as_of_date, as_of_date + 35 as known_on, case when n <= 5 then 'ST ' else '' end || exchange_code as name from seen
        union all
        select security_id, exchange_code, as_of_date, as_of_date + 120, exchange_code from seen where (security_id + month(as_of_date)) % 5 = 0"""),
    "rets": ("bars", """
        select security_id, trade_date, px, px / nullif(lag(px) over (partition by security_id order by trade_date), 0) - 1 as ret
        from (select security_id, trade_date, close * nullif(adj_factor, 0) as px from bars) z"""),
    "fac_price": ("rets", """
        select security_id, trade_date,
               case when d20 >= trade_date - 190 then px / nullif(p20, 0) - 1 end as mom_20,
               case when d60 >= trade_date - 190 then px / nullif(p60, 0) - 1 end as mom_60,
               case when d20 >= trade_date - 190 and n20 = 20 then s20 end as vol_20
        from (select *, lag(trade_date, 20) over w as d20, lag(px, 20) over w as p20, lag(trade_date, 60) over w as d60,
                     lag(px, 60) over w as p60, count(ret) over v as n20, stddev_samp(ret) over v as s20
              from rets window w as (partition by security_id order by trade_date),
                   v as (partition by security_id order by trade_date rows between 19 preceding and current row)) z"""),
    "fac_turn": ("basic", """
        select security_id, trade_date, case when turnover_rate is not null and n >= 15 then s / n end as turn_20
        from (select a.security_id, a.trade_date, a.turnover_rate, count(b.turnover_rate) as n, sum(b.turnover_rate) as s
              from (select *, row_number() over (partition by security_id order by trade_date) as rn from basic) a
              join (select *, row_number() over (partition by security_id order by trade_date) as rn from basic) b
                on b.security_id = a.security_id and b.rn between a.rn - 19 and a.rn and b.trade_date >= a.trade_date - 190
              group by 1, 2, 3) z"""),
    "fac_value": ("basic stmt", """
        select a.security_id, a.trade_date, arg_max(s.net_profit, row(s.report_date, s.ann_date, s.update_flag)) / (a.total_mv * 10000.0) as ep,
               arg_max(s.equity, row(s.report_date, s.ann_date, s.update_flag)) / (a.total_mv * 10000.0) as bp
        from basic a join stmt s on s.security_id = a.security_id and s.ann_date <= a.trade_date
        where a.total_mv > 0 group by a.security_id, a.trade_date, a.total_mv"""),
    "fac": ("fac_price fac_turn fac_value", """
        select * from (
          select security_id, trade_date, 'mom_20' as factor_name, mom_20 as value from fac_price
          union all select security_id, trade_date, 'mom_60', mom_60 from fac_price
          union all select security_id, trade_date, 'vol_20', vol_20 from fac_price
          union all select security_id, trade_date, 'turn_20', turn_20 from fac_turn
          union all select security_id, trade_date, 'ep', ep from fac_value
          union all select security_id, trade_date, 'bp', bp from fac_value) z where value is not null"""),
    "vers": ("bars0", """
        select 'daily_bar' as dataset, strftime(trade_date, '%Y-%m-%d') as version, trade_date, count(*) as row_count
        from bars0 where day(trade_date) % 13 <> 0 group by trade_date"""),
    "exec": ("lbars susp", """
        select b.security_id, b.exchange_code, b.trade_date, b.open * b.adj_factor as open, b.close, b.up_limit, b.down_limit,
               (b.is_suspended = 1 or s.suspend_date is not null) as suspended, cast(b.volume as double) as volume,
               b.close * b.adj_factor as mark
        from lbars b left join susp s on s.security_id = b.security_id and s.suspend_date = b.trade_date"""),
}


def _ordered(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0].split():
            visit(dep)
        if name not in seen:
            seen.append(name)

    for n in names:
        visit(n)
    return seen


def with_views(names: tuple[str, ...], body: str, out: str) -> str:
    """One statement: the needed views as CTEs, the body, and the output projection."""
    parts = [f"{n} as materialized ({VIEWS[n][1]})" for n in _ordered(names)] + [f"result_rows as ({body})"]
    recursive = "recursive " if "recursive_rows" in body else ""
    return f"with {recursive}" + ",\n".join(parts) + f"\nselect {out} from result_rows"
