"""Landed partitions, service tables and artefacts (S rows).

Queries that write do so under the session's shared work folder, in a fresh
directory each, and return what a reader sees afterwards.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from barloom.functions import values as v
from barloom.operators import calendar as cal, publish as pb, scd2
from barloom.schemas import conform, empty, landed, table
from barloom.session import work_dir
from barloom.sources import lake, tables as tb
from suite.base import query


def _root(m) -> str:
    return f"{work_dir(m.spark)}/lake-{uuid.uuid4().hex}"


def _two_sources(m):
    """Source a lacks every seventh day; source b has all days."""
    rows = m.raw_bars.withColumnRenamed("trade_date", "dt")
    a = rows.where(F.dayofmonth("dt") % 7 != 0).withColumn("source", F.lit("a"))
    return a.unionByName(rows.withColumn("source", F.lit("b")))


@query("S05_source_priority", "dt:d security_id:i source:s close:f", """
    select trade_date as dt, security_id, case when day(trade_date) % 7 <> 0 then 'a' else 'b' end as source, close from bars0""", "bars0")
def _(m):
    order = lake.priorities(m.spark, lake.candidate_order(["a"], ["b", "a"]))
    return lake.pick_source(_two_sources(m), order)


@query("S06_fallback_policy", "dt:d dataset:s source:s", """
    select trade_date as dt, dataset, case when dataset = 'daily_bar' then case when day(trade_date) % 7 <> 0 then 'a' else 'b' end
      when dataset = 'adj_factor' then case when day(trade_date) % 7 = 0 or day(trade_date) % 5 = 0 then 'b' else 'a' end
      else case when day(trade_date) % 7 = 0 or day(trade_date) % 5 = 0 then 'b' else 'a' end end as source
    from (select distinct trade_date from bars0) d cross join (select unnest(['daily_bar', 'adj_factor', 'suspend']) as dataset) n""", "bars0")
def _(m):
    days = m.raw_bars.select(F.col("trade_date").alias("dt")).distinct()
    grid = days.select("dt", F.explode(F.expr("array(struct('daily_bar' as dataset, 7 as k), struct('adj_factor' as dataset, 5 as k), struct('suspend' as dataset, 1 as k))")).alias("e"),
                       ).select("dt", "e.*")
    n = F.when(F.col("source") == "b", 10).when(F.col("dataset") == "suspend", 0).when(F.dayofmonth("dt") % F.col("k") == 0, 0).otherwise(10)
    counts = grid.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source")).withColumn("n", n)
    return lake.fallback_plan(counts, lake.priorities(m.spark, ["a", "b"]), ["daily_bar", "adj_factor", "suspend"])


@query("S09_parameterised_sql", "security_id:i n:i", "select security_id, count(*) as n from bars0 where trade_date >= date '1998-01-01' and close > 1000 group by 1", "bars0")
def _(m):
    m.raw_bars.createOrReplaceTempView("barloom_bars")
    return tb.query(m.spark, "select security_id, count(*) as n from barloom_bars where trade_date >= cast(:day as date) and close > :floor group by 1",
                    day="1998-01-01", floor=1000.0)


@query("S17_last_write_wins", "security_id:i trade_date:d volume:i", """
    select security_id, trade_date, case when security_id % 3 = 0 then volume + 7 else volume end as volume from bars0""", "bars0")
def _(m):
    first = m.raw_bars.select("security_id", "trade_date", "volume", F.lit(1).alias("load_ts"))
    later = first.where("security_id % 3 = 0").withColumns({"volume": F.col("volume") + 7, "load_ts": F.lit(2)})
    return tb.latest_rows(later.unionByName(first), ["security_id", "trade_date"])


@query("S19_reuse_gate", "source:s dataset:s dt:d reusable:b", """
    with c as (select trade_date as dt, count(*) as bar_n, count(*) filter (where (security_id + day(trade_date)) % 11 <> 0) as adj_n from bars0 group by 1)
    select 'a' as source, 'daily_bar' as dataset, dt, bar_n >= 15 as reusable from c
    union all select 'a', 'adj_factor', dt, adj_n >= 15 and (bar_n < 15 or adj_n >= floor(bar_n * 0.9::double)) from c
    union all select 'a', 'suspend', dt, day(dt) % 2 = 0 from c""", "bars0")
def _(m):
    part = F.col("trade_date").alias("dt")
    bars = m.raw_bars.groupBy(part).agg(F.count("*").alias("n")).withColumn("dataset", F.lit("daily_bar"))
    adj = m.raw_bars.groupBy(part).agg(F.count_if((F.col("security_id") + F.dayofmonth("trade_date")) % 11 != 0).alias("n")).withColumn("dataset", F.lit("adj_factor"))
    sus = m.raw_bars.groupBy(part).agg(F.lit(0).alias("z")).select("dt", F.when(F.dayofmonth("dt") % 2 == 0, F.lit(0).cast("bigint")).alias("n"), F.lit("suspend").alias("dataset"))
    counts = bars.unionByName(adj).unionByName(sus).withColumn("source", F.lit("a"))
    return pb.reusable(counts, 15)


@query("S20_incremental_range", "start:d finish:d fresh:b", """
    select least((select max(trade_date) from bars0 where security_id % 2 = 0 and trade_date < date '2000-01-01'), (select max(suspend_date) from susp)) + 1 as start,
           date '2001-06-30' as finish, true as fresh""", "bars0 susp")
def _(m):
    marks = {"daily_basic": (m.raw_bars.where("security_id % 2 = 0 and trade_date < '2000-01-01'"), "trade_date"), "suspend": (m.suspensions, "suspend_date")}
    return pb.incremental_range(marks, F.lit("2001-06-30").cast("date")).withColumnRenamed("end", "finish")


@query("S29_day_partitions", "dt:d n:i", "select trade_date as dt, count(*) as n from bars0 group by 1", "bars0")
def _(m):
    return lake.by_day(m.raw_bars).groupBy("dt").agg(F.count("*").alias("n"))


# ---- round trips ----------------------------------------------------------------------------


def _landed_months(m):
    """All bars, landed by month: dt is the first of the month."""
    return conform(m.limited_bars, landed("daily_bar")).withColumns({"source": F.lit("a"), "dt": F.trunc("trade_date", "month")})


_MONTH = "cast(date_trunc('month', trade_date) as date)"


@query("S01_replace_landed_partition", "exchange_code:s trade_date:d close:f", f"""
    select exchange_code, trade_date, case when month(trade_date) = 6 then close * 2 else close end as close from lbars where {_MONTH} <> date '1998-03-01'""", "lbars")
def _(m):
    root, rows = _root(m), _landed_months(m)
    lake.write_raw(rows, root, "daily_bar")
    lake.write_raw(rows.where("month(dt) = 6").withColumn("close", F.col("close") * 2), root, "daily_bar")
    lake.write_raw(rows.limit(0), root, "daily_bar", source="a", day="1998-03-01")
    return lake.scan(m.spark, root, "daily_bar")


@query("S02_manifest", "source:s dt:d writes:i last_rows:i prints:i", f"""
    select 'a' as source, {_MONTH} as dt, case when month(min(trade_date)) = 6 then 2 else 1 end as writes, count(*) as last_rows, 1 as prints from lbars group by 2""", "lbars")
def _(m):
    root, rows = _root(m), _landed_months(m)
    lake.write_raw(rows, root, "daily_bar")
    lake.write_raw(rows.where("month(dt) = 6"), root, "daily_bar")
    entries = lake.read_manifest(m.spark, root)
    # Landing the same rows again leaves the same fingerprint.
    return entries.groupBy("source", "dt").agg(F.count("*").alias("writes"), F.max_by("rows", "ts").alias("last_rows"),
                                               F.countDistinct("fingerprint").alias("prints")).withColumn("dt", F.to_date("dt"))


@query("S03_read_landed_partition", "exchange_code:s trade_date:d close:f", f"select exchange_code, trade_date, close from lbars where {_MONTH} = date '1998-06-01'", "lbars")
def _(m):
    root = _root(m)
    lake.write_raw(_landed_months(m), root, "daily_bar")
    return lake.read_raw(m.spark, root, "daily_bar", "a", "1998-06-01")


@query("S04_partition_counts", "dt:d n:i", f"""
    select cal_date as dt, case when cal_date = date '1998-01-03' then 0 else n end as n
    from cal left join (select {_MONTH} as k, count(*) as n from bars0 group by 1) b on k = cal_date""", "cal bars0")
def _(m):
    root, rows = _root(m), _landed_months(m)
    lake.write_raw(rows, root, "daily_bar")
    lake.write_raw(rows.limit(0), root, "daily_bar", source="a", day="1998-01-03")
    grid = m.calendar_days.select(F.lit("a").alias("source"), F.col("cal_date").alias("dt"))
    return lake.row_counts(m.spark, root, "daily_bar", grid)


@query("S07_landed_snapshots", "index_code:s exchange_code:s in_date:d out_date:d", "select * from members", "members")
def _(m):
    root = _root(m)
    snaps = m.index_snapshots.withColumnRenamed("as_of_date", "dt")  # the date only in the partition name
    lake.write_raw(snaps.withColumn("source", F.lit("a")), root, "index_member")
    return scd2.member_intervals(lake.snapshots(m.spark, root, "index_member", "a").select("index_code", "exchange_code", "as_of_date"))


@query("S08_typed_columns", "exchange_code:s trade_date:d pe_ttm:f total_mv:f", """
    select exchange_code, trade_date, cast(null as double) as pe_ttm, cast(null as double) as total_mv from lbars""", "lbars")
def _(m):
    none = empty(m.spark, landed("daily_basic"))
    return none.unionByName(conform(m.limited_bars, landed("daily_basic")))


@query("S10_append", "trade_date:d security_id:i volume:i", "select trade_date, security_id, volume from lbars where trade_date between date '1996-02-10' and date '2000-11-20'", "lbars")
def _(m):
    root, rows = _root(m), conform(m.limited_bars, table("daily_bar"))
    tb.append(rows.where("month(trade_date) <= 6"), root, "daily_bar")
    tb.append(rows.where("month(trade_date) > 6"), root, "daily_bar")
    tb.append(rows.limit(0), root, "daily_bar")
    return tb.read(m.spark, root, "daily_bar", start=dt.date(1996, 2, 10), end=dt.date(2000, 11, 20))


@query("S11_replace_days", "trade_date:d security_id:i volume:i", """
    select trade_date, security_id, case when trade_date = date '1998-06-15' then volume + 1 else volume end as volume from lbars where trade_date <> date '1998-06-16'""", "lbars")
def _(m):
    root, rows = _root(m), conform(m.limited_bars, table("daily_bar"))
    tb.append(rows, root, "daily_bar")
    again = rows.where("trade_date = '1998-06-15'").withColumn("volume", F.col("volume") + 1)
    tb.replace_days(again, root, "daily_bar", [dt.date(1998, 6, 15), dt.date(1998, 6, 16)])
    return tb.read(m.spark, root, "daily_bar")


@query("S12_empty_keeps_statements", "security_id:i ann_date:d update_flag:i net_profit:f2", "select security_id, ann_date, update_flag, net_profit from stmt", "stmt")
def _(m):
    root, rows = _root(m), conform(m.statements, table("fin_statement"))
    tb.append(rows, root, "fin_statement")
    tb.replace_days(rows.limit(0), root, "fin_statement", [dt.date(1998, 5, 20), dt.date(1998, 5, 21)], keep_when_empty=True)
    return tb.read(m.spark, root, "fin_statement").withColumn("net_profit", v.item(F.col("fields"), "net_profit"))


@query("S13_replace_factor_slice", "trade_date:d security_id:i factor_name:s version:s value:f8", """
    select trade_date, security_id, factor_name, 'v1' as version, case when trade_date = date '1998-06-15' and factor_name = 'mom_20' then value + 1 else value end as value
    from fac where factor_name in ('mom_20', 'turn_20') and trade_date <> date '1998-06-16' or factor_name = 'turn_20'""", "fac")
def _(m):
    root, rows = _root(m), m.stored().factors("mom_20", "turn_20")
    tb.write_partitioned(rows, root, "factor_value")
    bumped = rows.where("trade_date = '1998-06-15'").withColumn("value", F.col("value") + 1)
    tb.replace_factor_days(bumped, root, ["mom_20"], "v1", [dt.date(1998, 6, 15), dt.date(1998, 6, 16)])
    return tb.read(m.spark, root, "factor_value")


@query("S14_replace_intervals", "index_code:s security_id:i in_date:d out_date:d", """
    select index_code, security_id, in_date, out_date from members union all select 'IDX_B', security_id, in_date, out_date from members where security_id % 2 = 0""", "members")
def _(m):
    root, rows = _root(m), m.members
    other = rows.withColumn("index_code", F.lit("IDX_B"))
    tb.replace_intervals(rows.unionByName(other), root, "index_member", "index_code")
    tb.replace_intervals(other.where("security_id % 2 = 0"), root, "index_member", "index_code")
    return tb.read(m.spark, root, "index_member")


@query("S15_overwrite_master", "security_id:i exchange_code:s", "select security_id, exchange_code from listing where security_id % 2 = 0", "listing")
def _(m):
    root = _root(m)
    tb.overwrite(m.listing, root, "security_master")
    tb.overwrite(m.listing.where("security_id % 2 = 0"), root, "security_master")
    return tb.read(m.spark, root, "security_master")


@query("S16_calendar_upsert", "cal_date:d is_open:i", """
    select cal_date, case when cal_date between date '1998-02-01' and date '1998-02-28' then 0 else is_open end as is_open from cal""", "cal")
def _(m):
    closed = m.calendar_days.where("cal_date between '1998-02-01' and '1998-02-28'").withColumn("is_open", F.lit(0))
    return cal.upsert(m.calendar, closed)


@query("S18_appended_corrections", "security_id:i report_date:d first:f2 latest:f2", """
    select security_id, report_date, arg_min(net_profit, row(ann_date, update_flag)) as first, arg_max(net_profit, row(report_date, ann_date, update_flag)) as latest
    from stmt group by 1, 2""", "stmt")
def _(m):
    root, rows = _root(m), conform(m.statements, table("fin_statement"))
    tb.append(rows.where("update_flag = 0"), root, "fin_statement")
    tb.append(rows.where("update_flag = 1"), root, "fin_statement")
    stored = tb.read(m.spark, root, "fin_statement").withColumn("np", v.item(F.col("fields"), "net_profit"))
    return stored.groupBy("security_id", "report_date").agg(F.min_by("np", F.struct("ann_date", "update_flag")).alias("first"),
                                             F.max_by("np", F.struct("report_date", "ann_date", "update_flag")).alias("latest"))


def _last_quotes(m):
    """Latest quote of every code."""
    last = m.limited_bars.groupBy("exchange_code").agg(F.max_by(F.struct("close", "open", "high", "low"), "trade_date").alias("r"))
    return last.select("exchange_code", F.col("r.close").alias("price"), "r.open", "r.high", "r.low")


@query("S21_snapshot_landing", "exchange_code:s price:f stamp:s", """
    select exchange_code, close as price, '2001-12-31 10:30:00' as stamp from lbars qualify row_number() over (partition by exchange_code order by trade_date desc) = 1""", "lbars")
def _(m):
    root, quotes = _root(m), _last_quotes(m)
    lake.write_snapshot(quotes.withColumn("price", F.col("price") + 1), root, "a", dt.datetime(2001, 12, 31, 10, 0))
    lake.write_snapshot(quotes, root, "a", dt.datetime(2001, 12, 31, 10, 30))
    out = lake.latest_snapshot(m.spark, root, "a", "2001-12-31")
    return out.withColumn("stamp", F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss"))


@query("S22_snapshot_list", "dt:d ts:s codes:i", """
    select date '2001-12-31' as dt, t as ts, count(distinct security_id) as codes from bars0 cross join (select unnest(['100000', '103000']) as t) x group by 2""", "bars0")
def _(m):
    root, quotes = _root(m), _last_quotes(m)
    for minute in (0, 30):
        lake.write_snapshot(quotes, root, "a", dt.datetime(2001, 12, 31, 10, minute))
    n = quotes.agg(F.count("*")).scalar()
    return lake.list_snapshots(m.spark, root, "a", "2001-12-31").withColumn("codes", n)


def _curves(m):
    """Traded amount per board and day as a stand-in equity curve, run id = board."""
    return m.raw_bars.join(m.listing, "security_id").groupBy(F.col("board").alias("run_id"), "trade_date").agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("nav"))


@query("S23_run_archive", "run_id:s days:i last_nav:f2", """
    select board as run_id, count(distinct trade_date) as days, arg_max(nav, trade_date) as last_nav from (
      select board, trade_date, sum(cast(amount as decimal(18,2)))::double as nav from bars0 join listing using (security_id) group by 1, 2) z group by 1""", "bars0 listing")
def _(m):
    root, curves = _root(m), _curves(m)
    tb.save_artefact(curves.withColumn("nav", -F.col("nav")), root, "equity")
    tb.save_artefact(curves, root, "equity")  # the same run ids again replace the first archive
    return tb.load_artefact(m.spark, root, "equity").groupBy("run_id").agg(
        F.count("*").alias("days"), F.max_by("nav", "trade_date").alias("last_nav"))


@query("S24_run_listing", "run_id:s factor:s", """
    select board as run_id, case when board in ('main', 'gem') then 'mom_20' else 'ep' end as factor from listing where board in ('main', 'gem') group by 1""", "listing")
def _(m):
    root, curves = _root(m), _curves(m)
    meta = curves.groupBy("run_id").agg(F.max("trade_date").cast("timestamp").alias("created_at")).withColumn(
        "factor", F.when(F.col("run_id").isin("main", "gem"), "mom_20").otherwise("ep"))
    figures = curves.groupBy("run_id").agg(F.max("nav").alias("total_return"))
    tb.save_artefact(tb.pack_run(figures, meta, ["run_id"]), root, "run")
    return tb.list_artefacts(m.spark, root, "run", factor="mom_20")


@query("S25_experiment_summaries", "experiment_id:s cells:i best:f2", """
    select board as experiment_id, count(*) as cells, max(x) as best from (select board, year(trade_date) as y, max(close) as x from bars0 join listing using (security_id) group by 1, 2) z group by 1""", "bars0 listing")
def _(m):
    root = _root(m)
    cells = m.raw_bars.join(m.listing, "security_id").groupBy(F.col("board").alias("experiment_id"), F.year("trade_date").alias("y")).agg(F.max("close").alias("sharpe"))
    tb.save_artefact(cells.where("experiment_id <> 'bse'"), root, "experiment_run")
    cells.where("experiment_id in ('bse', 'gem')").write.option("header", "true").csv(f"{root}/legacy")
    legacy = tb.read_summary_csv(m.spark, f"{root}/legacy", "experiment_id string, y int, sharpe double")
    stored = tb.load_artefact(m.spark, root, "experiment_run")
    # Where both forms exist the table wins.
    return stored.unionByName(legacy.join(stored.select("experiment_id").distinct(), "experiment_id", "left_anti")).groupBy("experiment_id").agg(
        F.count("*").alias("cells"), F.max("sharpe").alias("best"))


@query("S26_signal_artefacts", "day:d signal_id:s names:i total:i", """
    select cast(date_trunc('month', trade_date) as date) as day, 'monthly' as signal_id, count(distinct security_id) as names, sum(volume) as total from bars0 group by 1""", "bars0")
def _(m):
    root = _root(m)
    rows = m.raw_bars.groupBy(F.trunc("trade_date", "month").alias("asof"), "security_id").agg(F.sum("volume").alias("weight")).withColumn("signal_id", F.lit("monthly"))
    tb.save_artefact(rows, root, "signal")
    return tb.load_artefact(m.spark, root, "signal", signal_id="monthly").groupBy(F.col("asof").alias("day"), "signal_id").agg(
        F.count("*").alias("names"), F.sum("weight").alias("total"))


@query("S27_mark_history", "session_id:s mark_date:d total_asset:f2", """
    select board as session_id, cast(date_trunc('month', trade_date) as date) as mark_date,
           sum(cast(amount as decimal(18,2)))::double + case when month(min(trade_date)) = 6 then 1 else 0 end as total_asset
    from bars0 join listing using (security_id) group by 1, date_trunc('month', trade_date)""", "bars0 listing")
def _(m):
    root = _root(m)
    marks = m.raw_bars.join(m.listing, "security_id").groupBy(F.col("board").alias("session_id"), F.trunc("trade_date", "month").alias("mark_date")).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total_asset"))
    tb.save_artefact(marks, root, "mark")
    tb.save_artefact(marks.where("month(mark_date) = 6").withColumn("total_asset", F.col("total_asset") + 1), root, "mark")
    return tb.load_artefact(m.spark, root, "mark")


@query("S28_artefact_listing", "experiment_id:s names:i", """
    select strftime(trade_date, 'exp_%Y%m') as experiment_id, count(*) as names from bars0 group by 1 order by 1 desc limit 50""", "bars0")
def _(m):
    root = _root(m)
    months = m.raw_bars.groupBy(F.concat(F.lit("exp_"), F.date_format("trade_date", "yyyyMM")).alias("experiment_id")).agg(F.count("*").alias("names"))
    tb.save_artefact(months, root, "experiment_run")
    return tb.list_artefacts(m.spark, root, "experiment_run", 50)
