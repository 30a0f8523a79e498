"""Row-level functions (P rows) and filters (F rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import rules
from barloom.functions import market as mk, scoring as sc, symbols as sy, trading as tr, values as v
from barloom.operators import calendar as cal, orders as od, prices as pr
from barloom.plans import build, research as rs
from suite.base import query

# A raw code and market text per part, spread over all first digits and lengths.
CODE = "cast((l_partkey * 7919 + 17) % 1000000 as varchar)"


def _codes(m):
    c = ((F.col("p_partkey") * 7919 + 17) % 1000000).cast("string")
    market = F.element_at(F.array(*[F.lit(x) for x in ("SH", "SZ", "BJ")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return m.table("part").select("p_partkey", c.alias("code"), F.concat(sy.zero_fill(c), F.lit("."), market).alias("xc"),
                                  market.alias("mkt"))


_CODES_SQL = """select p_partkey, code, n6, n6 || '.' || mkt as xc, mkt from (
    select p_partkey, code, case when length(code) < 6 then lpad(code, 6, '0') else code end as n6,
           case p_partkey % 3 when 0 then 'SH' when 1 then 'SZ' else 'BJ' end as mkt
    from (select p_partkey, cast((p_partkey * 7919 + 17) % 1000000 as varchar) as code from part) a) b"""


@query("P01_exchange_code", "p_partkey:i xc:s", f"""select p_partkey, n6 || case when n6[1] in ('4','8') then '.BJ'
    when n6[1] in ('5','6','9') then '.SH' else '.SZ' end as xc from ({_CODES_SQL}) c""")
def _(m):
    return _codes(m).select("p_partkey", sy.to_exchange_code(F.col("code")).alias("xc"))


@query("P02_pure_code", "p_partkey:i pure:s", f"select p_partkey, n6 as pure from ({_CODES_SQL}) c")
def _(m):
    return _codes(m).select("p_partkey", sy.number_part(F.col("xc")).alias("pure"))


@query("P03_market_first", "p_partkey:i sym:s", f"select p_partkey, lower(mkt) || n6 as sym from ({_CODES_SQL}) c")
def _(m):
    return _codes(m).select("p_partkey", sy.to_market_first(F.col("xc")).alias("sym"))


@query("P04_market_first_dotted", "p_partkey:i sym:s back:s",
       f"select p_partkey, lower(mkt) || '.' || n6 as sym, xc as back from ({_CODES_SQL}) c")
def _(m):
    dotted = sy.to_market_first(F.col("xc"), ".")
    return _codes(m).select("p_partkey", dotted.alias("sym"), sy.from_market_first(dotted).alias("back"))


@query("P05_long_suffix", "p_partkey:i sym:s back:s", f"""select p_partkey,
    n6 || case mkt when 'SH' then '.XSHG' when 'SZ' then '.XSHE' else '.XBSE' end as sym, xc as back from ({_CODES_SQL}) c""")
def _(m):
    long = sy.to_long_suffix(F.col("xc"))
    return _codes(m).select("p_partkey", long.alias("sym"), sy.from_long_suffix(long).alias("back"))


@query("P06_share_predicates", "p_partkey:i long_ok:b first_ok:b", f"""
    select p_partkey, ok as long_ok, ok as first_ok from (select p_partkey,
    case mkt when 'SH' then n6[1:2] in ('60','68') when 'SZ' then n6[1:2] in ('00','30') else n6[1] in ('4','8') end as ok
    from ({_CODES_SQL}) c) d""")
def _(m):
    return _codes(m).select(
        "p_partkey", sy.is_share_long_suffix(sy.to_long_suffix(F.col("xc"))).alias("long_ok"),
        sy.is_share_market_first(sy.to_market_first(F.col("xc"), ".")).alias("first_ok"),
    )


@query("P07_board", "p_partkey:i board:s", f"""select p_partkey, case mkt when 'BJ' then 'bse'
    when 'SH' then case when n6[1:3] = '688' then 'star' else 'main' end
    else case when n6[1:3] = '300' then 'gem' else 'main' end end as board from ({_CODES_SQL}) c""")
def _(m):
    return _codes(m).select("p_partkey", sy.board_of(F.col("xc")).alias("board"))


@query("P08_limit_prices", "security_id:i trade_date:d up_limit:f down_limit:f",
       "select security_id, trade_date, up_limit, down_limit from lbars", "lbars")
def _(m):
    return m.limited_bars


@query("P09_board_lot", "security_id:i trade_date:d lot:i", """
    select security_id, trade_date, case when q < lo then 0 else lo + ((q - lo) // st) * st end as lot from (
      select b.security_id, b.trade_date, b.volume // 7 as q, case l.board when 'star' then 200 else 100 end as lo,
             case when l.board in ('star', 'bse') then 1 else 100 end as st
      from bars0 b join listing l using (security_id)) z""", "bars0 listing")
def _(m):
    return m.raw_bars.join(m.listing, "security_id").select(
        "security_id", "trade_date", mk.board_lot(F.floor(F.col("volume") / 7), F.col("board")).alias("lot")
    )


@query("P10_no_limit_window", "security_id:i trade_date:d free:b", """
    select b.security_id, trade_date, (trade_date >= list_date and
      trade_date < list_date + cast(case when board in ('gem','star') then 5 else 1 end as integer)) as free
    from bars0 b join master m using (security_id)""", "bars0 master")
def _(m):
    rows = m.raw_bars.join(m.master, "security_id")
    return rows.select("security_id", "trade_date",
                       mk.in_no_limit_window(F.col("trade_date"), F.col("list_date"), F.col("board")).alias("free"))


@query("P10_no_limit_trading_days", "security_id:i trade_date:d free:b", """
    with days as (select cal_date, count(*) filter (where is_open = 1) over (order by cal_date) as k, is_open from cal)
    select b.security_id, b.trade_date, (b.trade_date >= m.list_date and d.k - f.k - (1 - f.is_open) < case when m.board in ('gem','star') then 5 else 1 end) as free
    from bars0 b join (select security_id, board, list_date - cast(security_id % 3 as integer) + 3 as list_date from master) m using (security_id)
    join days d on d.cal_date = b.trade_date join days f on f.cal_date = m.list_date""", "bars0 master cal")
def _(m):
    from barloom.operators import calendar as cal

    listed = m.master.select("security_id", "board", F.date_add("list_date", 3 - F.col("security_id") % 3).alias("list_date"))
    rows = m.raw_bars.select("security_id", "trade_date").join(listed, "security_id")
    return cal.in_no_limit_trading_days(rows, m.calendar)


@query("P11_board_fallback", "security_id:i b:s", """
    select security_id, case when security_id % 3 = 0 then case exchange_code[-2:] when 'BJ' then 'bse'
      when 'SH' then case when exchange_code[1:3] = '688' then 'star' else 'main' end
      else case when exchange_code[1:3] = '300' then 'gem' else 'main' end end else board end as b from listing""", "listing")
def _(m):
    stored = F.when(F.col("security_id") % 3 != 0, F.col("board")).otherwise("?")
    return m.listing.select("security_id", sy.board_or_inferred(stored, F.col("exchange_code")).alias("b"))


@query("P12_industry_label", "p_partkey:i label:s code:s name:s shown:s", """
    select p_partkey, label, code, name, case when name = '' then code else name end as shown from (
      select p_partkey, (801000 + p_partkey % 97) || '.SI' || case when nm = '' then '' else '|' || nm end as label,
             (801000 + p_partkey % 97) || '.SI' as code, nm as name
      from (select p_partkey, case when p_partkey % 5 = 0 then '' else p_brand end as nm from part) a) b""")
def _(m):
    name = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_brand"))
    rows = m.table("part").select("p_partkey", sy.industry_label((801000 + F.col("p_partkey") % 97).cast("string"), name).alias("label"))
    return rows.select("*", sy.industry_code(F.col("label")).alias("code"), sy.industry_name(F.col("label")).alias("name"),
                       sy.industry_display(F.col("label")).alias("shown"))


@query("P13_adjusted_prices", "security_id:i trade_date:d post:f pre:f", """
    select security_id, trade_date, close * adj_factor as post, close * (adj_factor / nullif(last_value(adj_factor) over
      (partition by security_id order by trade_date rows between unbounded preceding and unbounded following), 0)) as pre
    from bars""", "bars")
def _(m):
    return m.bars.select("security_id", "trade_date", (F.col("close") * pr.factor_in_range("post")).alias("post"),
                         (F.col("close") * pr.factor_in_range("pre")).alias("pre"))


@query("P14_adj_factor_from_closes", "exchange_code:s trade_date:d adj_factor:f", """
    select l.exchange_code, trade_date, (close * adj_factor) / close as adj_factor
    from bars b join listing l using (security_id) where close > 0""", "bars listing")
def _(m):
    coded = m.bars.join(m.listing.select("security_id", "exchange_code"), "security_id")
    return build.adj_factors(coded, coded.withColumn("close", F.col("close") * F.col("adj_factor")))


@query("P15_derived_pre_close", "security_id:i trade_date:d pre:f", """
    select security_id, trade_date, case security_id % 3 when 0 then close - (close - pre_close)
      when 1 then close / (1 + ((close / pre_close - 1) * 100) / 100.0) else close end as pre from bars""", "bars")
def _(m):
    k = F.col("security_id") % 3
    change = F.when(k == 0, F.col("close") - F.col("pre_close"))
    pct = F.when(k == 1, (F.col("close") / F.col("pre_close") - 1) * 100)
    return m.bars.select("security_id", "trade_date", mk.derived_pre_close(F.col("close"), change, pct).alias("pre"))


@query("P16_units", "security_id:i trade_date:d shares:i yuan:f guessed:i", """
    select security_id, trade_date, v * case security_id % 3 when 0 then 100 else 1 end as shares,
           amount * case security_id % 3 when 0 then 1000.0 else 1.0 end as yuan,
           case when v < 1000 then v * 100 else v end as guessed
    from (select *, volume // 100 as v from bars0) z""", "bars0")
def _(m):
    src = F.when(F.col("security_id") % 3 == 0, "lots").otherwise("shares")
    vol = F.floor(F.col("volume") / 100)
    return m.raw_bars.select(
        "security_id", "trade_date", mk.scaled(vol, src, {"lots": 100}, 1).alias("shares"),
        mk.scaled(F.col("amount"), src, {"lots": 1000.0}).alias("yuan"), mk.lots_or_shares(vol, 1000).alias("guessed"),
    )


@query("P17_column_aliases", "security_id:i trade_date:d open:f close:f volume:i missing:b", """
    select security_id, trade_date, open, close, volume, true as missing from bars0""", "bars0")
def _(m):
    vendor = m.raw_bars.select("security_id", "trade_date", F.col("open").alias("开盘"), F.col("close").alias("Close"),
                               F.when(F.col("security_id") % 2 == 0, F.col("volume")).alias("成交量"), F.col("volume").alias("vol"))
    return vendor.select(
        "security_id", "trade_date", v.first_alias(vendor, ["开盘", "open"]).alias("open"),
        v.first_alias(vendor, ["收盘", "close"], any_case=True).alias("close"), v.first_alias(vendor, ["成交量", "vol"]).alias("volume"),
        v.first_alias(vendor, ["换手率"]).isNull().alias("missing"),
    )


@query("P18_numeric_coercion", "event_id:i num:f cnt:i", """
    select event_id, try_cast(t as double) as num, cast(trunc(coalesce(try_cast(t as double), 0)) as bigint) as cnt
    from (select event_id, case event_id % 4 when 0 then event_type when 1 then '' else cast(value as varchar) end as t from events) z""")
def _(m):
    t = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, "").otherwise(
        F.col("value").cast("string"))
    return m.table("events").select("event_id", v.to_number(t).alias("num"), v.to_count(t).alias("cnt"))


@query("P19_date_parsing", "o_orderkey:i day:d ending:d", """
    select o_orderkey, d as day, case when d < date '2100-01-01' then d end as ending from (
      select o_orderkey, case o_orderkey % 4 when 0 then cast(o_orderdate as date) when 1 then cast(o_orderdate as date)
                              when 2 then null else date '2200-01-01' end as d from orders) z""")
def _(m):
    k = F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(k == 2, F.col("o_orderpriority")).otherwise("22000101"))
    return m.table("orders").select("o_orderkey", v.parse_ymd(text).alias("day"), v.parse_end_date(text).alias("ending"))


@query("P20_first_number", "event_id:i x:f", """
    select event_id, coalesce(try_cast(case when event_id % 3 = 0 then event_type end as double),
                              case when event_id % 3 < 2 then value end, 0.0) as x from events""")
def _(m):
    k = F.col("event_id") % 3
    rec = F.create_map(F.lit("now"), F.when(k == 0, F.col("event_type")).otherwise(""), F.lit("price"),
                       F.when(k < 2, F.col("value").cast("string")).otherwise(""))
    return m.table("events").select("event_id", v.first_number(rec, "now", "price", "missing").alias("x"))


@query("P21_quarter_ends", "trade_date:d ends:s", """
    select trade_date, strftime(q, '%Y-%m-%d') || ',' || strftime(q1, '%Y-%m-%d') as ends from (
      select trade_date, q, last_day(q - interval 3 month) as q1 from (
        select distinct trade_date, case when qe <= trade_date then qe else cast(qs as date) - 1 end as q from (
          select trade_date, date_trunc('quarter', trade_date) as qs,
                 cast(date_trunc('quarter', trade_date) + interval 3 month - interval 1 day as date) as qe from bars0) a) b) c""", "bars0")
def _(m):
    ends = v.recent_quarter_ends(F.col("trade_date"), 4)
    days = m.raw_bars.select("trade_date").distinct()
    return days.select("trade_date", F.array_join(F.transform(F.slice(ends, 1, 2), lambda d: F.date_format(d, "yyyy-MM-dd")), ",").alias("ends"))


@query("P22_item_map", "security_id:i ann_date:d update_flag:i keys:s total:f2", """
    select security_id, ann_date, update_flag, case when security_id % 4 = 0 then 'equity,revenue' else 'equity,net_profit,revenue' end as keys,
           revenue + equity + case when security_id % 4 = 0 then 0 else net_profit end as total from stmt""", "stmt")
def _(m):
    items = {"revenue": F.col("revenue"), "net_profit": F.when(F.col("security_id") % 4 != 0, F.col("net_profit")), "equity": F.col("equity")}
    rows = m.statement_rows.withColumn("fields", v.item_map(items))
    return rows.select(
        "security_id", "ann_date", "update_flag", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("keys"),
        F.aggregate(F.map_values("fields"), F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query("P23_map_lookup", "security_id:i ann_date:d update_flag:i net_profit:f2 has_eps:b",
       "select security_id, ann_date, update_flag, net_profit, false as has_eps from stmt", "stmt")
def _(m):
    return m.statements.select("security_id", "ann_date", "update_flag", v.item(F.col("fields"), "net_profit").alias("net_profit"),
                               v.has_item(F.col("fields"), "eps_basic").alias("has_eps"))


@query("P24_finite", "event_id:i ok:b", "select event_id, event_id % 5 not in (0, 1, 2) as ok from events")
def _(m):
    k = F.col("event_id") % 5
    x = (F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(None).cast("double"))
         .otherwise(F.col("value")))
    return m.table("events").select("event_id", v.is_finite(x).alias("ok"))


def _sided(m):
    return m.limited_bars.withColumn("side", F.when(F.dayofmonth("trade_date") % 2 == 0, "buy").otherwise("sell"))


_SIDED = "(select *, case when day(trade_date) % 2 = 0 then 'buy' else 'sell' end as side from lbars) s"


@query("P25_slippage", "security_id:i trade_date:d px:f", f"""
    select security_id, trade_date, close * (1.0 + 0.0005::double * case side when 'buy' then 1.0::double else -1.0::double end) as px from {_SIDED}""", "lbars")
def _(m):
    return _sided(m).select("security_id", "trade_date", tr.slipped(F.col("close"), F.col("side")).alias("px"))


@query("P26_fee", "security_id:i trade_date:d fee:f4", f"""
    select security_id, trade_date, greatest(amount * 0.0003::double, 5.0::double)
      + case side when 'sell' then amount * 0.0005::double else 0 end as fee from {_SIDED}""", "lbars")
def _(m):
    return _sided(m).select("security_id", "trade_date", tr.fee(F.col("amount"), F.col("side")).alias("fee"))


@query("P27_fill_cash", "security_id:i trade_date:d cash:f2", f"""
    select security_id, trade_date, case side when 'buy' then n + f else n - f end as cash from (
      select *, greatest(n * 0.0003::double, 5.0::double) + case side when 'sell' then n * 0.0005::double else 0 end as f from (
        select *, close * (1.0::double + 0.0005::double * case side when 'buy' then 1 else -1 end) * volume as n from {_SIDED}) a) b""", "lbars")
def _(m):
    return _sided(m).select("security_id", "trade_date", tr.fill(F.col("close"), F.col("volume"), F.col("side"))["cash"].alias("cash"))


@query("P28_lot_floor", "security_id:i trade_date:d lots:i shares:i", """
    select security_id, trade_date, cast(floor(amount / close / 100) * 100 as bigint) as lots, cast(floor(amount / close) as bigint) as shares
    from bars0""", "bars0")
def _(m):
    x = F.col("amount") / F.col("close")
    return m.raw_bars.select("security_id", "trade_date", tr.lot_floor(x).alias("lots"), tr.lot_floor(x, partial=True).alias("shares"))


@query("P29_executability", "security_id:i trade_date:d no_buy:s no_sell:s", """
    select security_id, trade_date, case when suspended then 'suspended' when open <= 0 then 'no_price'
        when up_limit > 0 and close >= up_limit * (1.0::double - 0.0001::double) then 'limit_up' end as no_buy,
      case when suspended then 'suspended' when open <= 0 then 'no_price'
        when down_limit > 0 and close <= down_limit * (1.0::double + 0.0001::double) then 'limit_down' end as no_sell from exec""", "exec")
def _(m):
    o, c, s = F.col("open"), F.col("close"), F.col("suspended")
    return m.execution.select("security_id", "trade_date", tr.buy_block(o, c, F.col("up_limit"), s).alias("no_buy"),
                              tr.sell_block(o, c, F.col("down_limit"), s).alias("no_sell"))


@query("P30_execution_price", "security_id:i trade_date:d at_open:f at_close:f", f"""
    select security_id, trade_date, open * k as at_open, close * k as at_close from (
      select *, 1.0::double + 0.0005::double * case side when 'buy' then 1.0::double else -1.0::double end as k from {_SIDED}) z""", "lbars")
def _(m):
    rows, side = _sided(m), F.col("side")
    return rows.select("security_id", "trade_date", tr.execution_price(F.col("open"), F.col("close"), side).alias("at_open"),
                       tr.execution_price(F.col("open"), F.col("close"), side, "next_close").alias("at_close"))


@query("P31_tradability_preview", "security_id:i trade_date:d at_up_limit:i at_down_limit:i tradable:i", """
    select *, case when is_suspended = 0 and at_up_limit = 0 and at_down_limit = 0 then 1 else 0 end as tradable from (
      select security_id, trade_date, is_suspended, case when close >= up_limit * (1 - 0.0001::double) then 1 else 0 end as at_up_limit,
             case when close <= down_limit * (1 + 0.0001::double) then 1 else 0 end as at_down_limit from lbars) z""", "lbars")
def _(m):
    return rs.tradability_preview(m.raw_bars.select("security_id", "trade_date"), m.limited_bars)


@query("P32_short_ids", "security_id:i trade_date:d id:s", """
    select security_id, trade_date, 'sig_' || substr(sha1('{"asof":"' || strftime(trade_date, '%Y-%m-%d') || '","factor":"mom_20","security":"' || security_id || '"}'), 1, 8) as id
    from bars0""", "bars0")
def _(m):
    parts = {"security": F.col("security_id"), "asof": F.col("trade_date"), "factor": F.lit("mom_20")}
    return m.raw_bars.select("security_id", "trade_date", v.short_id("sig", parts).alias("id"))


@query("P33_json_round_trip", "security_id:i trade_date:d total_return:f sharpe:f", """
    select security_id, trade_date, close as total_return, case when security_id % 2 = 0 then open end as sharpe from bars0""", "bars0")
def _(m):
    packed = m.raw_bars.select("security_id", "trade_date", F.to_json(F.struct(
        F.col("close").alias("total_return"), F.when(F.col("security_id") % 2 == 0, F.col("open")).alias("sharpe"))).alias("j"))
    return packed.select("security_id", "trade_date", F.from_json("j", "total_return double, sharpe double").alias("m")).select("*", "m.*")


@query("P34_dimension_scores", "security_id:i trade_date:d up:f10 down:f10 composite:f10", """
    select security_id, trade_date, 100.0 * p as up, 100.0 * (1.0 - q) as down,
           (coalesce(100.0 * p, 0) + coalesce(100.0 * (1.0 - q), 0)) / nullif((p is not null)::int + (q is not null)::int, 0) as composite
    from (select security_id, trade_date, cast(day(trade_date) as double) / 31 as p,
                 case when security_id % 3 <> 0 then cast(month(trade_date) as double) / 12 end as q from bars0) z""", "bars0")
def _(m):
    p = F.dayofmonth("trade_date").cast("double") / 31
    q = F.when(F.col("security_id") % 3 != 0, F.month("trade_date").cast("double") / 12)
    rows = m.raw_bars.select("security_id", "trade_date", sc.dimension_score(p, False).alias("up"), sc.dimension_score(q, True).alias("down"))
    return rows.withColumn("composite", sc.mean_present([F.col("up"), F.col("down")]))


@query("P35_stance", "security_id:i trade_date:d stance:s", """
    select security_id, trade_date, case when is_suspended = 1 then '偏弱' when comp is null and rs is null then 'unknown'
      when coalesce(comp, 50) + greatest(least(coalesce(rs, 0) * 100, 10), -10) >= 58 then '偏强'
      when coalesce(comp, 50) + greatest(least(coalesce(rs, 0) * 100, 10), -10) <= 42 then '偏弱' else '中性' end as stance
    from (select security_id, trade_date, is_suspended, case when day(trade_date) % 4 <> 0 then day(trade_date) * 3.25::double end as comp,
                 case when month(trade_date) % 3 <> 0 then (month(trade_date) - 6) * 0.03125::double end as rs from bars) z""", "bars")
def _(m):
    comp = F.when(F.dayofmonth("trade_date") % 4 != 0, F.dayofmonth("trade_date") * 3.25)
    rs_ = F.when(F.month("trade_date") % 3 != 0, (F.month("trade_date") - 6) * 0.03125)
    status = F.when(F.col("is_suspended") == 1, "blocked").otherwise("ok")
    return m.bars.select("security_id", "trade_date", sc.stance(comp, rs_, status).alias("stance"))


@query("P36_tags", "security_id:i trade_date:d tags:l", """
    select security_id, trade_date, coalesce(array_to_string([case when is_suspended = 1 then '停牌' end, case when is_st = 1 then 'ST' end,
      case when abs(close - up_limit) < 1e-6 then '涨停' end, case when abs(close - down_limit) < 1e-6 then '跌停' end,
      case when close > pre_close then '跑赢基准' end], ','), '') as tags from lbars""", "lbars")
def _(m):
    first = sc.tag_list([(F.col("is_suspended") == 1, "suspended"), (F.col("is_st") == 1, "st"),
                         (mk.touches(F.col("close"), F.col("up_limit")), "limit_up")])
    second = sc.tag_list([(F.col("is_st") == 1, "st"), (mk.touches(F.col("close"), F.col("down_limit")), "limit_down"),
                          (F.col("close") > F.col("pre_close"), "beats_benchmark")])
    return m.limited_bars.select("security_id", "trade_date", F.array_union(first, second).alias("tags"))


@query("P37_lag_buckets", "trade_date:d lag_days:i bucket:s finance:s", """
    select trade_date, lag_days, case when lag_days <= 0 then 'ok' when lag_days <= 3 then 'lag' else 'stale' end as bucket,
           case when lag_days <= 7 then 'ok' when lag_days <= 30 then 'lag' else 'stale' end as finance
    from (select distinct trade_date, (select max(trade_date) from bars0) - trade_date as lag_days from bars0) z""", "bars0")
def _(m):
    last = m.raw_bars.agg(F.max("trade_date")).scalar()
    days = m.raw_bars.select("trade_date").distinct().withColumn("lag_days", F.date_diff(last, "trade_date"))
    return days.select("*", sc.lag_bucket(F.col("lag_days"), 0, 3).alias("bucket"), sc.lag_bucket(F.col("lag_days"), 7, 30).alias("finance"))


@query("P38_target_shares", "security_id:i trade_date:d shares:i", """
    select security_id, trade_date, cast(floor(floor((100000000.0::double * w) / close) / 100) * 100 as bigint) as shares
    from (select *, (1 + security_id % 7) / 1000.0::double as w from bars0) z""", "bars0")
def _(m):
    w = (1 + F.col("security_id") % 7) / 1000.0
    return m.raw_bars.select("security_id", "trade_date", tr.target_shares(w, F.col("close"), 100_000_000.0).alias("shares"))


@query("P39_version_date", "o_orderkey:i pinned:d", """
    select o_orderkey, case when o_orderkey % 3 <> 0 then cast(o_orderdate as date) end as pinned from orders""")
def _(m):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "unpublished").when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00")))
    return m.table("orders").select("o_orderkey", v.version_date(text).alias("pinned"))


def _order_rows(m):
    day = m.raw_bars.agg(F.max("trade_date")).scalar()
    last = m.limited_bars.groupBy("exchange_code").agg(F.max_by(F.struct("close", "volume", "pre_close", "up_limit", "down_limit",
                                                                       "is_suspended", "is_st", "security_id"), "trade_date").alias("r"))
    quotes = last.select("exchange_code", F.col("r.close").alias("price"), "r.volume", "r.pre_close", "r.up_limit", "r.down_limit",
                         "r.is_suspended", "r.is_st")
    orders = last.select(
        "exchange_code", F.when(F.col("r.security_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        (F.col("r.security_id") * 37 % 900 + 1).alias("quantity"),
    )
    positions = last.select("exchange_code", F.lit(500).alias("quantity"))
    return day, orders, quotes, positions


@query("P40_order_screen", "exchange_code:s side:s quantity:i ok:b reasons:s adjusted_qty:i", """
    select exchange_code, side, quantity, reason is null as ok,
      coalesce(array_to_string([case when odd then 'lot_adjusted' end, reason], ','), '') as reasons,
      case when reason is null and odd then qty end as adjusted_qty
    from (select *, case when quantity < lo then 'below_min_lot' when is_suspended = 1 then 'suspended'
            when side = 'buy' and close >= up_limit - 1e-6 then 'limit_up' when side = 'sell' and close <= down_limit + 1e-6 then 'limit_down'
            when side = 'buy' and close * 1.0005::double * qty + greatest(close * 1.0005::double * qty * 0.0003, 5.0) > 2000000.0 + 1e-6 then 'cash'
            when side = 'sell' and qty > 500 then 'holding' end as reason
      from (select *, st > 1 and quantity % st <> 0 as odd, case when st > 1 and quantity % st <> 0 then
              case when quantity < lo then 0 else lo + ((quantity - lo) // st) * st end else quantity end as qty
        from (select exchange_code, is_suspended, close, up_limit, down_limit, case when security_id % 2 = 0 then 'buy' else 'sell' end as side,
                security_id * 37 % 900 + 1 as quantity, case board when 'star' then 200 else 100 end as lo,
                case when board in ('star', 'bse') then 1 else 100 end as st
              from lbars qualify row_number() over (partition by security_id order by trade_date desc) = 1) a) b) c""", "lbars")
def _(m):
    _, orders, quotes, positions = _order_rows(m)
    out = od.screen(orders, quotes, positions, cash=2_000_000.0, costs=tr.Costs())
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("P41_constituents", "exchange_code:s in_date:d as_of_date:d confidence:s", """
    select n6 || case when security_id % 3 = 0 then case when n6[1] in ('4','8') then '.BJ' when n6[1] in ('5','6','9') then '.SH' else '.SZ' end
                      when security_id % 3 = 1 then '.SH' else '.SZ' end as exchange_code,
           case when security_id % 2 = 0 then as_of_date else date '1995-01-05' end as in_date, as_of_date, 'snapshot' as confidence
    from (select *, lpad(cast(security_id as varchar), 6, '0') as n6 from index_snap) z""", "index_snap")
def _(m):
    k = F.col("security_id") % 3
    snaps = m.index_snapshots.join(m.listing.select("security_id", "exchange_code"), "exchange_code").select(
        F.col("security_id").alias("num"), F.when(k == 1, "上海证券交易所").when(k == 2, "Shenzhen Stock Exchange").alias("ex"),
        F.when(F.col("security_id") % 2 == 1, "19950105").alias("first"), F.col("as_of_date").alias("dt"),
    )
    return build.constituents(snaps, "IDX_A", number="num", exchange="ex", entry="first", label="snapshot")


@query("P42_vendor_codes", "p_partkey:i code:s", f"select p_partkey, n6 as code from ({_CODES_SQL}) c")
def _(m):
    return _codes(m).select("p_partkey", sy.clean_vendor_code(F.concat(F.col("mkt"), sy.zero_fill(F.col("code")))).alias("code"))


@query("P43_calendar_rows", "cal_date:d is_open:i", "select cal_date, is_open from cal", "cal")
def _(m):
    text = F.when(F.col("is_open") == 1, F.element_at(F.array(*[F.lit(x) for x in ("1", "true", "True")]),
                                                      (F.dayofmonth("cal_date") % 3 + 1).cast("int"))).otherwise("0")
    landed = m.calendar_days.select(F.date_format("cal_date", "yyyyMMdd").alias("d"), text.alias("o"))
    return cal.from_source_rows(landed, "d", "o")


# ---- filters ------------------------------------------------------------------------

_UNI = "select b.trade_date, b.exchange_code from lbars b join master m using (security_id) where "


def _uni(*filters):
    return lambda m: rs.universe(m.limited_bars, m.master, filters=filters)


query("F01_not_st", "trade_date:d exchange_code:s", _UNI + "b.is_st <> 1", "lbars master")(_uni("st"))
query("F02_not_suspended", "trade_date:d exchange_code:s", _UNI + "is_suspended <> 1", "lbars master")(_uni("suspended"))
query("F03_listed_120_days", "trade_date:d exchange_code:s", _UNI + "list_date <= trade_date - 120", "lbars master")(_uni("listed_days<120"))
query("F04_not_closed_at_limit", "trade_date:d exchange_code:s",
      _UNI + "not (is_suspended = 0 and abs(close - up_limit) < 1e-6)", "lbars master")(_uni("limit_up_open"))
query("F05_all_filters", "trade_date:d exchange_code:s", _UNI + """b.is_st <> 1 and is_suspended <> 1 and list_date <= trade_date - 120
      and not (is_suspended = 0 and abs(close - up_limit) < 1e-6)""", "lbars master")(_uni(*rules.UNIVERSE_FILTERS))


@query("F06_version_clamp", "trade_date:d exchange_code:s", _UNI + "trade_date <= date '1998-06-30'", "lbars master")
def _(m):
    import datetime as dt

    return rs.universe(m.limited_bars, m.master, end=dt.date(1999, 12, 31), version="1998-06-30")


@query("F07_code_and_range", "trade_date:d exchange_code:s close:f", """
    select trade_date, l.exchange_code, close from bars b join listing l using (security_id)
    where l.board = 'star' and trade_date between date '1996-01-01' and date '1997-12-31'""", "bars listing")
def _(m):
    import datetime as dt

    codes = m.listing.where("board = 'star'").select("exchange_code")
    return rs.get_price(m.bars, m.listing, codes=codes, start=dt.date(1996, 1, 1), end=dt.date(1997, 12, 31), adjust="none")


@query("F08_st_by_name", "security_id:i trade_date:d is_st:i", """
    select b.security_id, trade_date, case when contains(m.name, 'ST') and m.valid_from <= trade_date and m.valid_to > trade_date then 1 else 0 end as is_st
    from bars0 b join master m using (security_id)""", "bars0 master")
def _(m):
    from barloom.operators import asof

    spans = build.st_names(m.master).join(m.master.select("exchange_code", "security_id"), "exchange_code").drop("exchange_code")
    return asof.attach_interval(m.raw_bars, spans, ["security_id"], ["is_st"]).fillna({"is_st": 0})


@query("F08_st_known_then", "security_id:i trade_date:d is_st:i", """
    select b.security_id, b.trade_date, coalesce(max(case when contains(n.name, 'ST') then 1 else 0 end), 0) as is_st
    from bars0 b left join (
      select b.security_id, b.trade_date, arg_max(n.name, row(n.as_of_date, n.known_on)) as name
      from bars0 b join names n on n.security_id = b.security_id and n.as_of_date <= b.trade_date and n.known_on <= b.trade_date group by 1, 2) n
    on n.security_id = b.security_id and n.trade_date = b.trade_date group by 1, 2""", "bars0 names")
def _(m):
    coded = m.raw_bars.select("security_id", "trade_date").join(m.listing.select("security_id", "exchange_code"), "security_id")
    return build.st_known_then(coded, m.name_snapshots.select("exchange_code", "as_of_date", "known_on", "name"))


@query("F08_st_both_axes", "security_id:i trade_date:d st_then:i st_now:i", """
    with known as (select v, security_id, trade_date, arg_max(name, row(as_of_date, known_on)) as name from (
        select d.v, b.security_id, b.trade_date, n.name, n.as_of_date, n.known_on
        from bars0 b join names n on n.security_id = b.security_id and n.as_of_date <= b.trade_date
        join (select date '1996-06-30' as v union all select date '2099-01-01') d on n.known_on <= d.v) z group by 1, 2, 3)
    select b.security_id, b.trade_date, coalesce(cast(contains(x.name, 'ST') as integer), 0) as st_then, coalesce(cast(contains(y.name, 'ST') as integer), 0) as st_now
    from bars0 b left join known x on x.v = date '1996-06-30' and x.security_id = b.security_id and x.trade_date = b.trade_date
    left join known y on y.v = date '2099-01-01' and y.security_id = b.security_id and y.trade_date = b.trade_date""", "bars0 names")
def _(m):
    from barloom.operators import asof

    rows, ids = m.raw_bars.select("security_id", "trade_date"), m.listing.select("security_id", "exchange_code")
    for name, version in (("st_then", "1996-06-30"), ("st_now", None)):  # the same days as two versions of the master see them
        spans = build.st_names(build.master_history(m.name_snapshots, version)).join(ids, "exchange_code").withColumnRenamed("is_st", name)
        rows = asof.attach_interval(rows, spans.drop("exchange_code"), ["security_id"], [name]).fillna({name: 0})
    return rows


@query("F09_early_announcements", "report_date:d bad:i", """
    select report_date, count(*) filter (where a < report_date) as bad
    from (select *, ann_date - cast(45 as integer) as a from stmt) z group by 1""", "stmt")
def _(m):
    early = m.statements.withColumn("ann_date", F.date_sub("ann_date", 45))
    return early.groupBy("report_date").agg(F.count_if(F.col("ann_date") < F.col("report_date")).alias("bad"))


@query("F10_announced_on_day", "security_id:i ann_date:d report_date:d net_profit:f2", """
    select security_id, ann_date, report_date, net_profit from stmt where security_id % 3 <> 0 and ann_date >= report_date""", "stmt")
def _(m):
    shifted = F.when(F.col("security_id") % 3 == 0, F.date_add("ann_date", 1)).otherwise(F.col("ann_date"))
    landed = m.statement_rows.select(
        F.col("security_id").cast("string").alias("code"), F.date_format(shifted, "yyyyMMdd").alias("pubDate"),
        F.date_format("report_date", "yyyy-MM-dd").alias("statDate"), F.col("net_profit").alias("NP"), F.col("ann_date").alias("dt"),
    )
    out = build.announced_on_day(landed, {"np": "net_profit"}, code=F.col("code"), ann="pubDate", report="statDate")
    return out.withColumn("security_id", F.col("exchange_code").cast("int"))


@query("F11_valid_market_value", "security_id:i trade_date:d total_mv:f", """
    select security_id, trade_date, total_mv from basic where security_id % 4 <> 0 and total_mv > 0""", "basic")
def _(m):
    from barloom.operators import factors as fct

    odd = F.when(F.col("security_id") % 8 == 0, F.lit(float("nan"))).when(F.col("security_id") % 4 == 0, -F.col("total_mv"))
    return fct.valid_market_value(m.basic.withColumn("total_mv", F.coalesce(odd, F.col("total_mv"))))


@query("F12_first_codes", "security_id:i trade_date:d close:f", """
    select security_id, trade_date, close from bars0 where security_id in
      (select security_id from listing order by exchange_code limit 20)""", "bars0 listing")
def _(m):
    head = rs.first_codes(m.listing, 20)
    coded = m.raw_bars.join(m.listing.select("security_id", "exchange_code"), "security_id")
    return coded.join(head, "exchange_code", "left_semi")


@query("F13_suspended_from_status", "exchange_code:s suspend_date:d", """
    select distinct l.exchange_code, trade_date as suspend_date from bars b join listing l using (security_id) where is_suspended = 1""", "bars listing")
def _(m):
    coded = m.bars.join(m.listing.select("security_id", "exchange_code"), "security_id")
    status = coded.withColumn("tradeStatus", F.when(F.col("is_suspended") == 1, "0").otherwise("1"))
    return build.suspended_from_status(status, status="tradeStatus")
