"""Trading calendar.

A calendar has one row per date (at most some tens of thousands), so an
unpartitioned window over it and broadcasting it are both bounded by design.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom import rules
from barloom.functions import market as mk, values as v


def from_source_rows(df: DataFrame, day: str, is_open: str) -> DataFrame:
    """Landed calendar rows -> (cal_date, is_open); '1', 'true' and 'True' mean open."""
    opened = F.col(is_open).cast("string").isin("1", "true", "True")
    return df.select(
        v.parse_ymd(F.col(day)).alias("cal_date"), F.coalesce(opened, F.lit(False)).cast("int").alias("is_open")
    ).where("cal_date is not null")


def build(days: DataFrame) -> DataFrame:
    """Add the previous and next open day; at the edges they are the date itself."""
    w = Window.orderBy("cal_date")
    open_day = F.when(F.col("is_open") == 1, F.col("cal_date"))
    before = F.last(open_day, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(open_day, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return days.select(
        "cal_date", "is_open",
        F.coalesce(before, F.col("cal_date")).alias("prev_open"),
        F.coalesce(after, F.col("cal_date")).alias("next_open"),
    )


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace the covered range [min, max] of `incoming` in `existing`; links are made over all days, so they cross the seams."""
    days = incoming.select("cal_date", "is_open")
    span = days.agg(F.min("cal_date").alias("a"), F.max("cal_date").alias("b"))
    kept = existing.join(F.broadcast(span), F.col("cal_date").between(F.col("a"), F.col("b")), "left_anti")
    return build(kept.select("cal_date", "is_open").unionByName(days))


def open_days(calendar: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Trading days as `trade_date`, optionally within a closed range."""
    days = calendar.where("is_open = 1")
    if start is not None:
        days = days.where(F.col("cal_date") >= F.lit(start))
    if end is not None:
        days = days.where(F.col("cal_date") <= F.lit(end))
    return days.select(F.col("cal_date").alias("trade_date"))


def weekdays(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Stand-in where no calendar has been loaded: Monday to Friday."""
    if start > end:
        return spark.createDataFrame([], "trade_date date")
    span = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("trade_date"))
    return span.where(F.weekday("trade_date") < 5)


def is_trading_day(calendar: DataFrame, days: DataFrame, day: str = "trade_date") -> DataFrame:
    opened = calendar.where("is_open = 1").select(F.col("cal_date").alias(day), F.lit(True).alias("is_trading"))
    return days.join(F.broadcast(opened), day, "left").withColumn(
        "is_trading", F.coalesce("is_trading", F.lit(False))
    )


def previous_trading_day(calendar: DataFrame, days: DataFrame, day: str = "trade_date") -> DataFrame:
    """Latest open day strictly before each date; null before the calendar starts."""
    edges = calendar.select(
        F.col("cal_date").alias(day),
        F.when(F.col("prev_open") < F.col("cal_date"), F.col("prev_open")).alias("prev_day"),
    )
    return days.join(F.broadcast(edges), day, "left")


def link(df: DataFrame, calendar: DataFrame, column: str, name: str, day: str = "trade_date") -> DataFrame:
    """Attach `prev_open` or `next_open` of the row's date as `name` (null at the edge)."""
    steps = calendar.select(
        F.col("cal_date").alias(day), F.when(F.col(column) != F.col("cal_date"), F.col(column)).alias(name)
    )
    return df.join(F.broadcast(steps), day, "left")


def take_effect(signals: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals decided at the close of a day act on the next open day.

    Returns (acting rows with `exec_date`, dropped rows whose day is the last one).
    """
    linked = link(signals, calendar, "next_open", "exec_date")
    return linked.where("exec_date is not null"), linked.where("exec_date is null").drop("exec_date")


def ordinals(calendar: DataFrame) -> DataFrame:
    """(cal_date, ordinal): open days up to and including each date. One row per date, so one small window."""
    upto = Window.orderBy("cal_date").rowsBetween(Window.unboundedPreceding, 0)
    return calendar.select("cal_date", F.sum(F.col("is_open").cast("int")).over(upto).cast("int").alias("ordinal"))


def trading_days_between(df: DataFrame, calendar: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """Open days after `start` up to `end` as arithmetic on ordinals; null where a date lies outside the calendar."""
    numbered = F.broadcast(ordinals(calendar))  # a calendar holds one row per date
    first = numbered.select(F.col("cal_date").alias(start), F.col("ordinal").alias("__a"))
    last = numbered.select(F.col("cal_date").alias(end), F.col("ordinal").alias("__b"))
    return df.join(first, start, "left").join(last, end, "left").withColumn(name, F.col("__b") - F.col("__a")).drop("__a", "__b")


def in_no_limit_trading_days(df: DataFrame, calendar: DataFrame, *, day: str = "trade_date", name: str = "free") -> DataFrame:
    """The no-limit window counted in trading days: the first n open days from the listing on (`list_date`, `board`).

    A listing on a closed day counts from the next open one; a date before the listing is not in the window.
    """
    opened = calendar.select(F.col("cal_date").alias("list_date"), (1 - F.col("is_open").cast("int")).alias("__closed"))
    aged = trading_days_between(df, calendar, "list_date", day, "__age").join(F.broadcast(opened), "list_date", "left")
    inside = (F.col(day) >= F.col("list_date")) & (F.col("__age") - F.col("__closed") < F.coalesce(mk.by_board(rules.NO_LIMIT_DAYS, F.col("board")), F.lit(1)))
    return aged.withColumn(name, F.coalesce(inside, F.lit(False))).drop("__age", "__closed")
