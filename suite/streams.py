"""Streaming operators over the events table (ST rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.session import work_dir
from barloom.streaming import quotes as qs
from suite.base import query


def _quote_stream(m):
    """The events as a file stream of quotes: code = user, price = value."""
    raw = qs.read_quotes(m.spark, m.sf_dir, schema=m.table("events").schema, file_glob="events.parquet")
    return raw.select(
        F.col("user_id").cast("string").alias("exchange_code"), F.col("ts").cast("timestamp").alias("snapshot_ts"),
        F.col("value").alias("price"), F.col("event_id"),
    )


def _scratch(m) -> str:
    return f"{work_dir(m.spark)}/stream-{uuid.uuid4().hex}"


@query("ST1_latest_quote", "exchange_code:s price:f event_id:i", """
    select cast(user_id as varchar) as exchange_code, arg_max(value, row(ts, value, event_id)) as price, arg_max(event_id, row(ts, value, event_id)) as event_id
    from events group by 1""")
def _(m):
    root = _scratch(m)
    qs.start_latest(_quote_stream(m), f"{root}/latest", f"{root}/checkpoint").awaitTermination()
    return qs.read_latest(m.spark, f"{root}/latest")


@query("ST2_quote_view", "exchange_code:s price:f", """
    select cast(user_id as varchar) as exchange_code, arg_max(value, row(ts, value, event_id)) as price from events group by 1 order by 1 limit 500""")
def _(m):
    root = _scratch(m)
    qs.start_latest(_quote_stream(m), f"{root}/latest", f"{root}/checkpoint").awaitTermination()
    return qs.quote_view(qs.read_latest(m.spark, f"{root}/latest"))


@query("ST3_incremental_landing", "event_type:s n:i", "select event_type, count(*) as n from events group by 1")
def _(m):
    root, schema = _scratch(m), m.table("events").schema
    for _run in range(2):  # the second run finds nothing new
        qs.incremental(m.spark, m.sf_dir, f"{root}/landed", f"{root}/checkpoint", schema, file_glob="events.parquet").awaitTermination()
    return m.spark.read.parquet(f"{root}/landed").groupBy("event_type").agg(F.count("*").alias("n"))


_BARS = """select cast(user_id as varchar) as exchange_code, strftime(s, '%Y-%m-%d %H:%M:%S') as start_text, open, high, low, close, n as volume from (
    select user_id, s, arg_min(value, row(ts, value, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, value, event_id)) as close, count(*) as n
    from ({source}) e group by 1, 2) z where s + interval {size} minute <= (select max(ts) - interval 10 minute from events)"""


def _window_rows(m, **options):
    root = _scratch(m)
    bars = qs.window_bars(_quote_stream(m), code="exchange_code", price="price", ts="snapshot_ts", tie=["price", "event_id"], **options)
    qs.start_to_parquet(bars, f"{root}/bars", f"{root}/checkpoint").awaitTermination()
    return m.spark.read.parquet(f"{root}/bars").withColumn("start_text", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("ST4_window_bars_tumbling", "exchange_code:s start_text:s open:f high:f low:f close:f volume:i",
       _BARS.format(source="select *, time_bucket(interval 30 minute, ts) as s from events", size=30))
def _(m):
    return _window_rows(m, size="30 minutes")


@query("ST4_window_bars_sliding", "exchange_code:s start_text:s open:f high:f low:f close:f volume:i", _BARS.format(
    source="select e.*, time_bucket(interval 30 minute, ts) - k * interval 30 minute as s from events e cross join (select unnest([0, 1]) as k) o", size=60))
def _(m):
    return _window_rows(m, size="60 minutes", slide="30 minutes")


_SESSIONS = """select exchange_code, strftime(s, '%Y-%m-%d %H:%M:%S') as start_text, strftime(e + interval {gap} minute, '%Y-%m-%d %H:%M:%S') as end_text, open, high, low, close, ticks from (
    select user_id, cast(user_id as varchar) as exchange_code, k, min(ts) as s, max(ts) as e, arg_min(value, row(ts, value, event_id)) as open, max(value) as high,
           min(value) as low, arg_max(value, row(ts, value, event_id)) as close, count(*) as ticks
    from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from (
      select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval {gap} minute then 1 else 0 end as fresh
      from events window w as (partition by user_id order by ts, event_id)) a) b group by 1, 2, 3) z"""
_SESSION_COLS = "exchange_code:s start_text:s end_text:s open:f high:f low:f close:f ticks:i"


def _session_rows(df):
    shown = {"start_text": F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "end_text": F.date_format("end", "yyyy-MM-dd HH:mm:ss")}
    return df.withColumns(shown).drop("start", "end")


@query("ST5_sessions", _SESSION_COLS, _SESSIONS.format(gap=720))
def _(m):
    events = m.table("events").select(F.col("user_id").cast("string").alias("exchange_code"), F.col("ts").cast("timestamp").alias("snapshot_ts"),
                                      F.col("value").alias("price"), "event_id")
    return _session_rows(qs.sessions(events, code="exchange_code", price="price", ts="snapshot_ts", gap="720 minutes", tie=["price", "event_id"]))


@query("ST5_sessions_streamed", _SESSION_COLS, _SESSIONS.format(gap=720) + " where e + interval 720 minute <= (select max(ts) - interval 10 minute from events)")
def _(m):
    root = _scratch(m)
    found = qs.sessions(_quote_stream(m), code="exchange_code", price="price", ts="snapshot_ts", gap="720 minutes", tie=["price", "event_id"])
    qs.start_to_parquet(found, f"{root}/sessions", f"{root}/checkpoint").awaitTermination()
    return _session_rows(m.spark.read.parquet(f"{root}/sessions"))
